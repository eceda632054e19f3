import numpy as np
import pytest
from pyspark.sql import functions as F

from sievetree.plans.tree import Model, Node, Params, check
from sievetree.sources import workload
from sievetree.streaming import update
from sievetree.streaming.update import Updater

NO_BOXES = np.zeros((0, 4, 2))


def made(spark, n, tied=False, seed=1):
    """Two clusters; c and d are independent of each other in both, or d follows c in the second."""
    rng = np.random.default_rng(seed)
    side = rng.integers(0, 2, n)
    a, b = side * 100.0 + rng.integers(0, 5, n), side * 100.0 + rng.integers(0, 5, n)
    c, d = rng.integers(0, 6, n).astype(float), rng.integers(0, 6, n).astype(float)
    d = np.where(tied & (side == 1), c, d)
    return spark.createDataFrame(np.column_stack([a, b, c, d]).tolist(), "a double, b double, c double, d double")


def fixed():
    sides = [Node("product", [0, 1, 2, 3], [Node("leaf", [i]) for i in range(4)], "data") for _ in range(2)]
    root = Node("sum", [0, 1, 2, 3], sides, centres=[[2.0, 2.0, 2.5, 2.5], [102.0, 102.0, 2.5, 2.5]], fill=[0.0] * 4)
    for i, node in enumerate(root.walk()):
        node.number = i
    return root


def rows_of(df):
    return np.array(df.collect(), float)


def test_only_the_subtree_that_drifts_is_learned_anew(spark, tmp_path, monkeypatch):
    table = made(spark, 2000)
    monkeypatch.setattr(update.Model, "fit", classmethod(lambda cls, df, columns, boxes, params: Model.from_counts(columns, fixed(), df.count(), update.count(df, columns, fixed()))))
    up = Updater(table, table.columns, NO_BOXES, str(tmp_path / "u"), params=Params(sample=4000))
    old = up.model.root
    more = made(spark, 3000, tied=True, seed=2)
    bad = up.insert(more)
    assert bad == [old.children[1].number] and up.rebuilt == 1
    check(up.model.root)
    left, right = up.model.root.children
    assert [c.columns for c in left.children] == [[0], [1], [2], [3]] and any(len(n.columns) == 2 and set(n.columns) == {2, 3} for n in right.walk())
    values = rows_of(table.unionAll(more))
    box = lambda **k: (np.array([k.get(c, (-np.inf, np.inf))[0] for c in "abcd"]), np.array([k.get(c, (-np.inf, np.inf))[1] for c in "abcd"]))
    lo, hi = box(a=(100, 200), c=(2, 2), d=(2, 2))
    true = ((values >= lo) & (values <= hi)).all(1).mean()
    assert abs(up.model.probability(lo, hi) - true) < 0.02
    # The part that was kept has the counts of all rows.
    again = Model.from_counts(list("abcd"), up.model.root, 5000, update.count(up.rows, list("abcd"), up.model.root))
    for query in (box(a=(0, 50), c=(1, 3)), box(b=(0, 3), d=(0, 1)), box(a=(100, 102))):
        assert abs(up.model.probability(*query) - again.probability(*query)) < 1e-9


def test_a_restart_goes_on_and_leaves_out_what_it_has(spark, tmp_path):
    table = made(spark, 800)
    path = str(tmp_path / "u")
    up = Updater(table, table.columns, NO_BOXES, path, params=Params(sample=800))
    up.sink("events")(made(spark, 100, seed=3), 0)
    up.sink("events")(made(spark, 50, seed=4), 1)
    again = Updater(table, table.columns, NO_BOXES, path, params=Params(sample=800))
    assert again.model.rows == 950 and again.rows.count() == 950
    again.sink("events")(made(spark, 50, seed=4), 1)
    assert again.model.rows == 950
    again.sink("events")(made(spark, 10, seed=5), 2)
    assert again.model.rows == 960 and again.rows.count() == 960
    lo, hi = np.array([0.0, -np.inf, -np.inf, -np.inf]), np.array([50.0, np.inf, np.inf, np.inf])
    true = (rows_of(again.rows)[:, 0] <= 50).mean()
    assert abs(again.model.probability(lo, hi) - true) < 0.02


def test_a_state_that_was_not_finished_is_not_there(spark, tmp_path):
    table = made(spark, 300)
    path = str(tmp_path / "u")
    up = Updater(table, table.columns, NO_BOXES, path, params=Params(sample=300))
    def fail(*_):
        raise RuntimeError("lost")
    up._adopt = fail
    with pytest.raises(RuntimeError):
        up.insert(made(spark, 50, seed=3), 0)
    again = Updater(table, table.columns, NO_BOXES, path, params=Params(sample=300))
    assert again.model.rows == 300 and again.rows.count() == 300
    again.insert(made(spark, 50, seed=3), 0)
    assert again.model.rows == 350 and again.rows.count() == 350


def test_deletes(spark, tmp_path):
    table = made(spark, 500)
    up = Updater(table, table.columns, NO_BOXES, str(tmp_path / "u"), params=Params(sample=500))
    some = table.where("c = 1")
    n = some.count()
    up.delete(some)
    assert up.model.rows == 500 - n == up.rows.count()
    lo, hi = np.full(4, -np.inf), np.full(4, np.inf)
    lo[2] = hi[2] = 1.0
    assert up.model.probability(lo, hi) < 0.02
    with pytest.raises(Exception, match="not there"):
        up.delete(some)


def test_splits_that_part_new_queries_badly():
    inf = np.inf
    node = Node("split", [0, 1], [Node("product", [0, 1], [Node("leaf", [0]), Node("leaf", [1])], "data") for _ in range(2)], masks=[[1], [3]])
    for i, n in enumerate(node.walk()):
        n.number = i
    asked = lambda *masks: np.array([[[0, 1] if m & 1 << c else [-inf, inf] for c in range(2)] for m in masks])
    rows = np.random.default_rng(1).random((200, 2))
    assert update.drifted(node, rows, rows, asked(1, 3, 3), asked(1, 3)) == []
    assert update.drifted(node, rows, rows, asked(1, 3, 3), asked(2, 3)) == [0]


def test_true_rows_and_intervals(spark, tmp_path):
    table = made(spark, 1000)
    rng = np.random.default_rng(7)
    statements = []
    for i in range(120):
        if i % 3 == 0:
            statements.append([[float(rng.integers(0, 5)), -1], [float(rng.integers(0, 5)), -1], [1.0, -1], [2.0, -1]])
        else:
            statements.append([[0, float(rng.integers(1, 110))], [-np.inf, np.inf], [0, 4], [-np.inf, np.inf]])
    statements = np.array(statements, float)
    frame = workload.from_updates(spark, statements)
    got = {r.seq: r.card for r in update.true_rows(table, table.columns, frame).collect()}
    rows = rows_of(table)
    for i, s in enumerate(statements):
        if (s[:, 1] == -1).all():
            rows = np.vstack([rows, s[:, 0]])
        else:
            assert got[i] == ((rows >= s[:, 0]) & (rows <= s[:, 1])).all(1).sum()
    up = Updater(table, table.columns, NO_BOXES, str(tmp_path / "u"), params=Params(sample=1000))
    report = update.intervals(up, frame)
    assert [r["interval"] for r in report] == list(range(1, 11)) and report[-1]["rows"] > 1000
    assert all(1 <= r["mean_without_worst"] <= r["mean"] < 3 for r in report)


def test_columns_of_many_values(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 10, 3000)
    table = spark.createDataFrame([(float(v), float(i % 2)) for i, v in enumerate(x)], "x double, y double")
    up = Updater(table, ["x", "y"], np.zeros((0, 2, 2)), str(tmp_path / "u"), params=Params(max_bins=100))
    assert "x" in up.model.grid
    up.insert(spark.createDataFrame([(200.0, 1.0)] * 600, "x double, y double").withColumn("x", F.col("x") + F.rand(3)))
    assert abs(up.model.probability(np.array([150.0, -np.inf]), np.array([np.inf, np.inf])) - 600 / 3600) < 0.01
    up.insert(spark.createDataFrame([(-300.0, 1.0)] * 400, "x double, y double"))
    values = np.array([r.x for r in up.rows.collect()])
    for lo, hi in ((-np.inf, -100.0), (-300.0, -300.0), (-5.0, 5.0), (10.0, 300.0), (60.0, 150.0)):
        assert abs(up.model.probability(np.array([lo, -np.inf]), np.array([hi, np.inf])) - ((values >= lo) & (values <= hi)).mean()) < 0.02

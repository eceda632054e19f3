import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievetree.functions import leaves
from sievetree.operators import dependence as dep
from sievetree.operators import workload_stats as ws
from sievetree.plans import join_model as jm
from sievetree.plans.tree import Model, Node, Params, check, learn
from sievetree.sources import tables, workload
from sievetree.streaming.update import Updater

FREE = np.array([-np.inf, np.inf])


def boxes(n, columns, *bounds):
    out = np.tile(FREE, (n, columns, 1))
    for q, c, lo, hi in bounds:
        out[q, c] = lo, hi
    return out


def rows_of(spark, name, n=6000):
    t = tables.toy(spark, name, n)
    return t, np.array(t.collect(), float)


@pytest.mark.parametrize("name", tables.TOYS)
def test_toys_are_seeded(spark, name):
    a, b = tables.toy(spark, name, 200), tables.toy(spark, name, 200)
    assert len(a.columns) in (8, 10) and a.collect() == b.collect()


def test_structure_follows_dependence(spark):
    _, free = rows_of(spark, "independent_iclr")
    root = learn(free, np.zeros((0, 10, 2)), Params())
    assert root.kind == "product" and all(c.kind == "leaf" for c in root.children)
    _, tied = rows_of(spark, "totally_iclr")
    assert learn(tied, np.zeros((0, 10, 2)), Params()).kind == "sum"
    _, groups = rows_of(spark, "medium_correlated_cat")
    root = learn(groups, np.zeros((0, 10, 2)), Params())
    assert root.kind == "product" and any(len(c.columns) > 1 for c in root.children)


def test_workload_splits(spark):
    _, tied = rows_of(spark, "totally_iclr")
    apart = boxes(40, 10, *[(q, q % 2 * 5 + i, 0, 3) for q in range(40) for i in range(5)])
    root = learn(tied, apart, Params())
    assert root.kind == "product" and root.by == "workload" and sorted(map(len, (c.columns for c in root.children))) == [5, 5]
    mixed = boxes(60, 10, *[(q, i, 0, 3) for q in range(60) for i in (range(6) if q % 2 else range(5, 10))])
    kinds = {n.kind for n in learn(tied, mixed, Params()).walk()}
    assert "split" in kinds


@pytest.mark.parametrize("name", ["independent_cat", "highly_correlated_cat", "totally_iclr"])
def test_estimates(spark, tmp_path, name):
    t, rows = rows_of(spark, name)
    n = rows.shape[1]
    queries = boxes(30, n, *[(q, c, q % 5, q % 5 + 6) for q in range(30) for c in (q % n, (q + 1) % n)])
    model = Model.fit(t, t.columns, queries, Params(sample=3000))
    w = workload.from_boxes(spark, queries, t.columns)
    got = model.estimate(w).join(ws.true_cardinality(t, w), "qid").collect()
    assert len(got) == 30
    errors = sorted(max(r.estimate / r.card, r.card / r.estimate) for r in got if r.card)
    assert errors[len(errors) // 2] < 1.5
    for r in got:
        inside = ((rows >= queries[r.qid][:, 0]) & (rows <= queries[r.qid][:, 1])).all(1).sum()
        assert r.card == inside
    model.save(spark, str(tmp_path / "m"))
    again = Model.load(spark, str(tmp_path / "m"))
    assert all(math.isclose(again.probability(q[:, 0], q[:, 1]), model.probability(q[:, 0], q[:, 1])) for q in queries)
    free = np.tile(FREE, (n, 1))
    assert model.probability(free[:, 0], free[:, 1]) == 1.0
    part = model.marginal(t.columns[:2])
    two = boxes(1, n, (0, 0, 0, 4), (0, 1, 0, 4))[0]
    assert math.isclose(part.probability(two[:, 0], two[:, 1]), model.probability(two[:, 0], two[:, 1]))
    assert abs(model.expectation("a1", free[:, 0].copy(), free[:, 1].copy()) - rows[:, 0].mean()) < 0.15
    drawn = model.draw(4000, 1)
    assert np.abs(drawn.mean(0) - rows.mean(0)).max() < 0.1 * rows.std(0).max() + 0.5
    assert model.most_probable({"a1": 3.0})["a1"] == 3.0


def test_nulls(spark):
    t = spark.createDataFrame([(float(i % 5), None if i % 4 == 0 else float(i % 3)) for i in range(400)], "a double, b double")
    model = Model.fit(t, ["a", "b"], np.zeros((0, 2, 2)), root=_numbered(Node("product", [0, 1], [Node("leaf", [0]), Node("leaf", [1])], "data")))
    lo, hi = np.array([-np.inf, 0.0]), np.array([np.inf, 2.0])
    assert abs(model.probability(lo, hi) - 0.75) < 1e-9
    empty = Model.fit(t.where("false"), ["a", "b"], np.zeros((0, 2, 2)))
    assert empty.probability(lo, hi) == 0.0


def _numbered(root):
    for i, n in enumerate(root.walk()):
        n.number = i
    return root


def test_check_rejects():
    with pytest.raises(ValueError):
        check(_numbered(Node("product", [0, 1], [Node("leaf", [0]), Node("leaf", [0])])))


def test_rdc():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    m = dep.rdc(np.column_stack([x, x * x, rng.normal(size=3000), np.zeros(3000)]))
    assert m[0, 1] > 0.6 and m[0, 2] < 0.25 and m[0, 3] == 0 and np.allclose(m, m.T)


def test_split_queries():
    sides, cut = ws.split_queries([(0b0011, 10), (0b1100, 10), (0b0010, 1), (0b1000, 1)])
    assert len(sides) in (1, 2) and 0 <= cut <= 1
    sides, cut = ws.split_queries([(0b111, 9), (0b110, 9)])
    assert sorted(sides) == [[6], [7]] and cut == 1


def test_normalise_rejects_unknown_operator(spark):
    lines = spark.createDataFrame([(0, "t##t.a,<>,3#1")], "qid long, value string")
    with pytest.raises(Exception, match="unknown operator"):
        workload.normalise(workload.parse_joins(lines)).collect()


def test_variants(spark):
    lines = spark.createDataFrame([(0, "c,u#c.UserId=u.Id#c.Score,=,1#5"), (1, "c##c.Score,=,1#5")], "qid long, value string")
    got = {r.qid: r.tables for r in workload.table_variants(workload.parse_joins(lines), {"c": {"UserId": "c_nouser"}}).collect()}
    assert got == {0: ["c", "u"], 1: ["c_nouser"]}


def test_updates_from_array(spark):
    got = workload.from_updates(spark, np.array([[[1, -1], [2, -1]], [[0, 5], [-np.inf, np.inf]]])).collect()
    assert [r.is_insert for r in got] == [True, False] and got[0].lo == [1.0, 2.0]


def test_delete_of_what_is_not_there(spark):
    a = spark.createDataFrame([("x", 1.0, 3)], "col string, v double, n long")
    with pytest.raises(Exception, match="not in the leaf"):
        leaves.update(a, spark.createDataFrame([("x", 1.0, 4)], "col string, v double, n long"), -1).collect()
    assert leaves.update(a, a, -1).count() == 0


def test_join_estimate_is_exact_without_filters(spark):
    a = spark.createDataFrame([(i,) for i in range(100)], "k long")
    b = spark.createDataFrame([(i % 50, i % 7) for i in range(500)], "k long, j long")
    c = spark.createDataFrame([(i % 7,) for i in range(21)], "j long")
    bins = (0.0, 1.0)
    est = jm.estimate({"a": (a, {"k": bins}, None), "c": (c, {"j": bins}, None), "b": (b, {"k": bins, "j": bins}, None)}, [("a", "k", "b", "k"), ("b", "j", "c", "j")])
    assert abs(est.first().estimate - 500 * 3) < 1e-6
    with pytest.raises(ValueError):
        jm.estimate({"a": (a, {"k": bins}, None), "b": (b, {"k": bins}, None)}, [])


@pytest.mark.parametrize("method", ["none", "retrain", "adaptive"])
def test_update_methods(spark, tmp_path, method):
    t, _ = rows_of(spark, "independent_cat", 1500)
    up = Updater(t, t.columns, np.zeros((0, 8, 2)), str(tmp_path / method), method, Params(sample=1500))
    up.insert(t.limit(300))
    assert up.model.rows == (1500 if method == "none" else 1800) and up.rebuilt == (method == "retrain")
    tied = t.withColumn("a2", F.col("a1"))
    bad = up.insert(tied.limit(400))
    assert (bad == []) == (method == "none")
    if method != "none":
        assert up.model.rows == 2200


def test_stream_of_inserts(spark, tmp_path):
    t, _ = rows_of(spark, "independent_cat", 800)
    up = Updater(t, t.columns, np.zeros((0, 8, 2)), str(tmp_path / "u"), "adaptive", Params(sample=800))
    t.write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(up.sink()).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert up.model.rows == 1600
    sink = up.sink()
    sink(t.limit(10), 0)
    sink(t.limit(10), 0)
    assert up.model.rows == 1610

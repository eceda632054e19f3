"""What a fitted tree answers after conditioning, re-weighting and simplifying, against enumeration of its bins and against the rows."""

import math

import numpy as np
import pytest

from sievetree.plans import transforms as tf
from sievetree.plans.tree import Model, Node, check

FREE = (np.full(2, -np.inf), np.full(2, np.inf))


def leaf(c):
    return Node("leaf", [c])


def numbered(root):
    for i, n in enumerate(root.walk()):
        n.number = i
    return root


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    g = rng.random(600) < 0.3
    rows = [(float(x), float(y) if k % 20 else None) for k, (x, y) in enumerate(zip(rng.integers(0, 3, 600) + 10 * g, rng.integers(0, 4, 600) + 20 * g, strict=True))]
    return spark.createDataFrame(rows, "a double, b double")


@pytest.fixture(scope="module")
def model(table):
    root = Node("sum", [0, 1], [Node("product", [0, 1], [leaf(0), leaf(1)], "data"), Node("product", [0, 1], [leaf(0), leaf(1)], "data")], centres=[[1.0, 1.5], [11.0, 21.5]], fill=[4.0, 7.5])
    return Model.fit(table, ["a", "b"], np.tile(np.array([-np.inf, np.inf]), (1, 2, 1)), root=numbered(root))


def unpruned(model):
    """The same model whose boxes miss no query: a point in an empty bin has that bin's share."""
    return Model(model.columns, model.root, model.rows, model.bins, model.weights, {k: dict.fromkeys(model.columns, [-np.inf, np.inf]) for k in model.weights})


def test_likelihood_of_rows(spark, model, table):
    got = tf.likelihood(model, table).collect()
    assert len(got) == table.count()
    for r in got[:50]:
        lo, hi = FREE[0].copy(), FREE[1].copy()
        for i, v in enumerate((r.a, r.b)):
            if v is not None:
                lo[i] = hi[i] = v
        assert abs(math.exp(r.log_likelihood) - unpruned(model).probability(lo, hi)) < 1e-9
    given = {(r.a, r.b): r.log_likelihood for r in tf.likelihood(model, table, ["a"]).collect()}
    marginal = {(r.a, r.b): r.log_likelihood for r in tf.likelihood(model, table.selectExpr("a", "cast(null as double) b")).collect()}
    whole = {(r.a, r.b): r.log_likelihood for r in got}
    assert all(abs(v - (whole[k] - marginal[(k[0], None)])) < 1e-9 for k, v in given.items())
    out = tf.likelihood(model, spark.createDataFrame([(-5.0, 1.0, "x")], "a double, b double, other string")).first()
    assert out.log_likelihood == -math.inf and out.other == "x"
    assert tf.likelihood(model, table.limit(0)).count() == 0


def test_condition_and_moments(model):
    lo, hi = np.array([1.0, -np.inf]), np.array([12.0, np.inf])
    inside = tf.condition(model, lo, hi)
    box = np.array([11.0, 20.0]), np.array([12.0, 21.0])
    assert abs(inside.probability(*box) - model.probability(*box) / model.probability(lo, hi)) < 1e-9
    assert abs(inside.rows - model.rows * model.probability(lo, hi)) < 1e-6
    bins = []
    for part in model.root.children:
        b = model.bins[part.children[1].number]
        share = model.weights[part.number] / sum(model.weights.values()) * b["non_null"]
        bins += [((lo_ + hi_) / 2, share * p) for lo_, hi_, p in zip(b["lo"], b["hi"], b["pdf"], strict=True)]
    for order in (1, 2, 3):
        want = sum(p * x**order for x, p in bins) / sum(p for _, p in bins)
        assert abs(tf.moment(model, "b", order) - want) < 1e-6 * max(1, want)
    assert abs(tf.variance(model, "b") - (tf.moment(model, "b", 2) - tf.moment(model, "b") ** 2)) < 1e-9
    assert tf.moment(model, "a", 1, np.array([-np.inf, 20.0]), FREE[1]) > 9
    with pytest.raises(ValueError):
        tf.condition(model, np.array([500.0, -np.inf]), np.array([600.0, np.inf]))


def test_reweigh_finds_the_shares(model, table):
    wrong = Model(model.columns, model.root, model.rows, model.bins, {k: 300 for k in model.weights}, model.bounds)
    fixed = tf.reweigh(wrong, table)
    far = table.where("a >= 10").count()
    low, high = (fixed.weights[c.number] for c in model.root.children)
    assert abs(high - far) < 3 and abs(low + high - table.count()) < 1e-6
    before = tf.likelihood(wrong, table).agg({"log_likelihood": "sum"}).first()[0]
    assert tf.likelihood(fixed, table).agg({"log_likelihood": "sum"}).first()[0] > before


def test_gradients(model):
    row = np.array([1.0, 2.0])
    got = tf.gradients(model, row)
    value = tf.values(model, row[None])
    leaves = [n for n in model.root.walk() if n.kind == "leaf" and n.columns == [0]]
    # The probability is linear in the leaves of one column.
    assert got[0] == 1.0 and abs(sum(got[n.number] * value[n.number][0] for n in leaves) - value[0][0]) < 1e-12


def test_simplified_shared_narrowed(table):
    tower = Node("product", [0, 1], [Node("product", [0], [leaf(0)]), Node("product", [1], [Node("product", [1], [leaf(1)])])], "data")
    model = Model.fit(table, ["a", "b"], np.tile(np.array([-np.inf, np.inf]), (1, 2, 1)), root=numbered(tower))
    short = tf.simplified(model)
    check(short.root)
    lo, hi = np.array([1.0, 2.0]), np.array([11.0, 21.0])
    assert [n.kind for n in short.root.walk()] == ["product", "leaf", "leaf"] and abs(short.probability(lo, hi) - model.probability(lo, hi)) < 1e-12
    wide = tf.narrowed(Node("product", list(range(7)), [leaf(i) for i in range(7)], "data"), 2)
    check(wide)
    assert max(len(n.children) for n in wide.walk()) == 2 and sorted(n.columns[0] for n in wide.walk() if n.kind == "leaf") == list(range(7))
    twice = numbered(Node("sum", [0], [leaf(0), leaf(0)], centres=[[1.0], [99.0]], fill=[0.0]))
    same = Model(["a"], twice, 2, {1: {"lo": [0.0], "hi": [0.0], "pdf": [1.0], "non_null": 1.0}, 2: {"lo": [0.0], "hi": [0.0], "pdf": [1.0], "non_null": 1.0}}, {1: 1, 2: 1}, {})
    assert tf.shared_parts(same) == {0: 0, 1: 1, 2: 1}


def test_text_forms(model):
    again = tf.from_text(tf.to_text(model))
    lo, hi = np.array([1.0, 2.0]), np.array([11.0, 21.0])
    assert again.probability(lo, hi) == model.probability(lo, hi) and again.rows == model.rows and again.columns == model.columns
    assert tf.formula(model).count("f") == 4 and tf.formula(model).startswith("(0.")

import numpy as np
import pytest

from sievetree.plans import transforms
from sievetree.plans.tree import Model, Node, Params, check, learn

INF = np.inf


def rows(n=6000, seed=1):
    """c and d are tied to each other and follow a; b is free."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 20, n), rng.integers(0, 6, n)
    c = a // 5 * 10 + rng.integers(0, 10, n)
    d = c + rng.integers(0, 2, n)
    return np.column_stack([a, b, c, d]).astype(float)


def box(**k):
    return np.array([k.get(c, (-INF, INF))[0] for c in "abcd"], float), np.array([k.get(c, (-INF, INF))[1] for c in "abcd"], float)


def truth(x, lo, hi):
    return ((x >= lo) & (x <= hi) | ((lo == -INF) & (hi == INF))).all(1).mean()


@pytest.mark.parametrize("how", ["median", "grid"])
def test_columns_given_others(spark, tmp_path, how):
    x = rows()
    root = learn(x, np.zeros((0, 4, 2)), Params(strong=0.9, by_conditions=how))
    check(root)
    found = [n for n in root.walk() if n.kind == "factorize"]
    assert found and set(found[0].columns) - set(found[0].given) == {2, 3}
    at = np.arange(len(x))
    parts = [found[0].in_box(i, x) for i in range(len(found[0].ranges))]
    assert (np.sum(parts, axis=0) == 1).all() and len(parts) > 1
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double")
    model = Model.fit(df, list("abcd"), np.zeros((0, 4, 2)), root=root)
    for query in (box(a=(3, 7), c=(5, 14)), box(c=(0, 9), d=(0, 4)), box(b=(1, 2), d=(30, 40)), box(a=(12, 12)), box(a=(0, 4), c=(30, 39)), box(a=(2, 9), b=(0, 3), c=(3, 12), d=(4, 12))):
        assert abs(model.probability(*query) - truth(x, *query)) < 0.03, query
    assert model.probability(*box()) == 1.0
    model.save(spark, str(tmp_path / "m"))
    for again in (Model.load(spark, str(tmp_path / "m")), transforms.from_text(transforms.to_text(model))):
        check(again.root)
        assert again.probability(*box(a=(3, 7), c=(5, 14))) == model.probability(*box(a=(3, 7), c=(5, 14)))
    drawn = model.draw(4000, 2)
    assert abs(np.corrcoef(drawn[:, 0], drawn[:, 2])[0, 1] - np.corrcoef(x[:, 0], x[:, 2])[0, 1]) < 0.1 and len(at) == len(x)
    best = model.most_probable({"a": 17.0})
    assert best["a"] == 17 and best["c"] >= 20
    assert model.marginal(["a", "b"]).probability(*box(a=(0, 9))) == model.probability(*box(a=(0, 9)))
    assert "box(" in transforms.formula(model)
    leaves = transforms.factorized_parts(model)
    assert {r["column"] for r in leaves} == {"c", "d"} and all(set(r["box"]) <= {"a", "b"} for r in leaves)
    point = transforms.values(model, x[:50])[model.root.number]
    assert (point > 0).mean() > 0.9 and np.allclose(transforms.values(model, np.full((1, 4), np.nan))[model.root.number], 1.0)
    assert abs(transforms.moment(model, "c") - x[:, 2].mean()) < 0.5
    with pytest.raises(ValueError):
        transforms.condition(model, *box(a=(0, 3)))


def test_no_factorize_node_by_default():
    assert all(n.kind != "factorize" for n in learn(rows(1500), np.zeros((0, 4, 2)), Params()).walk())


def test_null_is_below_all_and_bad_nodes_are_refused():
    node = Node("factorize", [0, 1], [Node("leaf", [0]), Node("leaf", [1]), Node("leaf", [1])], given=[0], ranges=[[[-INF, 3.0]], [[3.0, INF]]])
    for i, n in enumerate(node.walk()):
        n.number = i
    check(node)
    x = np.array([[np.nan, 1.0], [3.0, 1.0], [4.0, 1.0], [-np.inf, 1.0]])
    assert node.in_box(0, x).tolist() == [True, True, False, True] and node.in_box(1, x).tolist() == [False, False, True, False]
    node.ranges = node.ranges[:1]
    with pytest.raises(ValueError):
        check(node)

"""Row, column and query splits on made samples; Chow-Liu trees and mixtures against brute force."""

import itertools

import numpy as np
import pytest

from sievetree.functions import densities
from sievetree.operators import splits
from sievetree.plans.chow_liu import ChowLiu
from sievetree.plans.tree import Model, Params, check


@pytest.fixture(scope="module")
def two():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.5, (150, 3)), rng.normal(8, 0.5, (250, 3))]
    x[5, 1] = np.nan
    return x


@pytest.mark.parametrize("how", sorted(set(splits.ROWS) - {"rdc"}))
def test_row_splits_find_two_clusters(two, how):
    label = splits.ROWS[how](two)
    assert {tuple(sorted(set(label[:150].tolist()))), tuple(sorted(set(label[150:].tolist())))} == {(0,), (1,)}


def test_rank_features_part_low_from_high(two):
    """Ranks do not see the gap: the cut is near the median, so the smaller cluster stays whole and the larger may be cut."""
    label = splits.ROWS["rdc"](np.nan_to_num(two, nan=0.0))
    low = label[:150]
    assert (low == low[0]).mean() > 0.95 and (label[150:] != low[0]).mean() > 0.7


def test_density_of_one_cloud_and_of_none():
    assert set(splits.density_labels(np.zeros((50, 2)))) == {0}
    assert set(splits.density_labels(np.arange(20.0)[:, None] * 100)) == {0}


def test_condition_cuts():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 2, 800).astype(float)
    rows = np.column_stack([g * 5 + rng.normal(size=800), g + 0.01 * rng.normal(size=800), rng.normal(size=800)])
    assert splits.median_cut(rows, [0], [1, 2])[0] == 2
    column, cut = splits.best_cut(rows, [0], [1])
    assert column == 1 and 0.0 < cut < 1.0
    assert splits.best_cut(rows[:8], [0], [1]) is None
    assert splits.distinct_or_median(np.array([0.0, 1.0, 1.0])) == [0.5]
    assert splits.distinct_or_median(np.array([1.0, 2.0, 3.0, 3.0, 3.0, 3.0])) == [2.0]
    assert splits.condition_centres(rows, [1, 2]).shape == (2, 2)
    bits = np.column_stack([g, g, rng.integers(0, 2, 800)])
    assert splits.likeliest_binary(bits, [0, 1, 2]) in (0, 1) and splits.likeliest_binary(np.ones((9, 1)), [0]) is None


def test_poisson_columns():
    rng = np.random.default_rng(1)
    a = rng.poisson(4, 1500)
    rows = np.column_stack([a, rng.poisson(1 + a), rng.poisson(3, 1500)]).astype(float)
    assert sorted(map(sorted, splits.poisson_groups(rows))) == [[0, 1], [2]]
    null = [splits.stability_p(rng.poisson(3, 400).astype(float), rng.normal(size=400)) for _ in range(200)]
    assert 0.01 < np.mean(np.array(null) <= 0.05) < 0.12
    assert splits.stability_p(np.ones(5), np.arange(5.0)) == 1.0
    assert splits.bonferroni(np.array([0.4]), 3).tolist() == [1.0]


def test_query_split_by_means():
    sides, quality = splits.split_queries_by_means([(0b0011, 40), (0b0001, 3), (0b1100, 30)], 4)
    assert sorted(map(sorted, sides)) == [[0b0001, 0b0011], [0b1100]] and quality > 0.2
    assert splits.split_queries_by_means([(0b1, 9)], 4)[0] == [[0b1]]


@pytest.mark.parametrize("params", [Params(by_rows="gmm", by_queries="kmeans"), Params(by_rows="dbscan"), Params(by_columns="poisson")])
def test_trees_with_other_splits(spark, two, params):
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(round(v, 1)) for v in r) for r in two], "a double, b double, c double")
    boxes = np.tile(np.array([-np.inf, np.inf]), (4, 3, 1))
    boxes[:2, 0] = boxes[2:, 1] = 0.0, 9.0
    model = Model.fit(df, ["a", "b", "c"], boxes, params)
    check(model.root)
    assert abs(model.probability(np.array([4.0, -np.inf, -np.inf]), np.full(3, np.inf)) - 250 / 400) < 0.08


def test_chow_liu_against_its_own_table(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 3, 500)
    b = (a + (rng.random(500) < 0.2)) % 3
    c = (b * 2 + (rng.random(500) < 0.3)) % 4
    df = spark.createDataFrame([(int(x), int(y), int(z)) for x, y, z in zip(a, b, c, strict=True)] + [(None, 1, 1)], "a int, b int, c int")
    tree = ChowLiu.fit(df, ["a", "b", "c"])
    assert tree.parent == {"a": None, "b": "a", "c": "b"}
    cells = {v: tree.probability(dict(zip("abc", v, strict=True))) for v in itertools.product(*(tree.values[k] for k in "abc"))}
    assert abs(sum(cells.values()) - 1) < 1e-9
    assert abs(tree.probability({"b": 1.0, "c": float("nan")}) - sum(p for v, p in cells.items() if v[1] == 1)) < 1e-9
    best = max((p, v) for v, p in cells.items() if v[2] == 3)[1]
    assert tuple(tree.most_probable({"c": 3.0}).values()) == best
    drawn = tree.draw(20000, 1)
    assert abs((drawn[:, 1] == 1).mean() - tree.probability({"b": 1.0})) < 0.02
    assert tree.probability({"a": 99.0}) == 0
    with pytest.raises(ValueError):
        ChowLiu.fit(df, ["a", "b", "c"], most_cells=2)
    assert ChowLiu.fit(df, ["a"]).probability({"a": 0.0}) > 0.2
    assert ChowLiu.fit(df.limit(0), ["a", "b"]).probability({"a": 0.0}) == 0


def test_mixture(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, 600), rng.normal(20, 2, 400)]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    low, high = sorted(densities.mixture(df, "x"), key=lambda p: p["mean"])
    assert abs(low["weight"] - 0.6) < 0.01 and abs(low["mean"]) < 0.2 and abs(high["mean"] - 20) < 0.4 and abs(high["stdev"] - 2) < 0.3
    assert densities.mixture(df.limit(0), "x") == []


def test_pairs_of_keys_and_bucket_parts(spark):
    from sievetree.plans import join_model as jm

    assert jm.paired_keys({("a", "b"): 0.9, ("b", "c"): 0.95, ("a", "c"): 0.1}, 0.5) == [("b", "c"), ("a",)]
    t = spark.createDataFrame([(k,) for k in [0, 0, 0, 1, 5, 5, 9]], "k long")
    whole = {r.bucket: r for r in jm.bucket_stats(t, "k", 2, 0, 9).collect()}
    for r in jm.bucket_union([jm.bucket_stats(t.where("k < 5"), "k", 2, 0, 9), jm.bucket_stats(t.where("k >= 5"), "k", 2, 0, 9)]).collect():
        assert (r.n, r.ndv) == (whole[r.bucket].n, whole[r.bucket].ndv) and r.mcv_n >= whole[r.bucket].mcv_n


def test_special_values_make_a_skewed_join_exact(spark):
    from sievetree.plans import join_model as jm

    a = spark.createDataFrame([(0,)] * 500 + [(k,) for k in range(1, 50)] + [(None,)], "k long")
    b = spark.createDataFrame([(0,)] * 300 + [(k,) for k in range(1, 50)], "j long")
    top = jm.ranked(jm.special_values([(a, "k"), (b, "j")], 1))
    tables = {"a": (a, {"k": (0, 50)}, None), "b": (b, {"j": (0, 50)}, None)}
    joins = [("a", "k", "b", "j")]
    assert abs(jm.estimate(tables, joins, special={"k": top, "j": top}).first().estimate - (500 * 300 + 49)) < 1
    assert jm.estimate(tables, joins).first().estimate < 10_000


def test_parametric_draws(spark):
    from pyspark.sql import functions as F

    from sievetree.functions import leaves, parametric

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(v),) for v in rng.geometric(0.3, 3000)], "x double")
    one = leaves.fit(df, "x").first().asDict()
    rows = spark.range(20000).select(*[F.lit(float(v)).alias(k) for k, v in one.items()])
    for family in ("gaussian", "exponential", "geometric"):
        assert abs(rows.select(parametric.draw(family, 3).alias("v")).agg(F.avg("v")).first()[0] - one["gaussian_mean"]) < 0.15
    assert rows.limit(1).select(parametric.density("gamma", F.lit(None))).first()[0] == 1.0
    with pytest.raises(ValueError):
        parametric.density("none", F.lit(1))


def test_sampling_baseline(spark):
    from pyspark.sql import functions as F

    from sievetree.plans import join_variants as jv

    t = spark.range(20000).withColumn("x", F.when(F.col("id") % 50 > 0, F.col("id") % 5))
    assert jv.sampled(t, F.col("x") == 1, 1.0).first().estimate == t.where("x = 1").count()
    rough = jv.sampled(t, F.col("x") == 1, 0.1).first()
    assert abs(rough.estimate - 4000) < 800 and 1500 < rough.sampled < 2500
    assert jv.sampled(t.limit(0), F.col("x") == 1).first().estimate == 1.0


def test_factorize_with_nulls_and_correlation(spark):
    from sievetree.plans import factorize

    rows = [(float(k % 10), float(k % 10 >= 5) * 100 + k % 3) for k in range(3000)] + [(None, 7.0), (3.0, None)] * 30
    t = spark.createDataFrame(rows, "a double, b double")
    cuts = factorize.equal_mass(t, "a", 2)
    node = factorize.Factorized.fit(t, ["a"], ["b"], {"a": cuts})
    queries = spark.createDataFrame([(0, "a", 5.0, 9.0), (0, "b", 100.0, 102.0), (1, "b", 100.0, 102.0), (2, "a", 0.0, 4.0), (3, "a", 50.0, 60.0), (4, "a", 0.0, 4.0), (4, "b", 100.0, 102.0)], "qid long, col string, lo double, hi double")
    got = {r.qid: r.estimate for r in node.estimate(queries).collect()}
    assert cuts == [4.0] and abs(got[0] - 1500) < 15 and abs(got[1] - 1500) < 30 and got[2] == 1530 and got[3] == 0 and got[4] < 15
    empty = factorize.Factorized.fit(t.limit(0), ["a"], ["b"], {"a": cuts})
    assert all(r.estimate == 0 for r in empty.estimate(queries).collect())
    assert factorize.equal_mass(t.limit(0), "a", 4) == []

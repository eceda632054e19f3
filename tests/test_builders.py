import numpy as np
import pytest
from pyspark.sql import functions as F

from sievetree.functions import parametric
from sievetree.operators import splits
from sievetree.plans import transforms
from sievetree.plans.tree import Model, Params

INF = np.inf


def test_products_and_mixtures_of_models(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (2000, 3)).astype(float)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    fit = lambda d, *c: Model.fit(d, list(c), np.zeros((0, len(c), 2)))
    ab, c = fit(df, "a", "b"), fit(df, "c")
    both = transforms.times(ab, c)
    lo, hi = np.array([1.0, 0.0, 2.0]), np.array([3.0, 2.0, 4.0])
    assert np.isclose(both.probability(lo, hi), ab.probability(lo[:2], hi[:2]) * c.probability(lo[2:], hi[2:]))
    low, high = fit(df.where("a < 2"), "a", "b"), fit(df.where("a >= 2"), "b", "a")
    mix = transforms.mixed([(1.0, low), (3.0, high)])
    want = 0.25 * low.probability(lo[:2], hi[:2]) + 0.75 * high.probability(lo[1::-1], hi[1::-1])
    assert np.isclose(mix.probability(lo[:2], hi[:2]), want)
    assert mix.probability(np.full(2, -INF), np.full(2, INF)) == 1.0
    with pytest.raises(ValueError):
        transforms.times(ab, ab)
    with pytest.raises(ValueError):
        transforms.mixed([(1.0, ab), (1.0, c)])


def test_binary_trees(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2, 3000)
    x = np.column_stack([a, np.where(rng.random(3000) < 0.95, a, 1 - a), rng.integers(0, 2, 3000)]).astype(float)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    model = Model.fit_binary(df, ["a", "b", "c"], Params(sample=3000))
    lo, hi = np.array([1.0, 0.0, -INF]), np.array([1.0, 0.0, INF])
    assert abs(model.probability(lo, hi) - ((x[:, 0] == 1) & (x[:, 1] == 0)).mean()) < 0.02
    with pytest.raises(ValueError):
        Model.fit_binary(df.withColumn("c", F.lit(2.0)), ["a", "c"])


def test_random_condition():
    x = np.array([[0, 1, 5, 0], [1, 1, 6, 1], [0, 1, 7, 0]], float)
    found = {splits.random_binary(x, [0, 1, 2, 3], s) for s in range(20)}
    assert found == {0, 3} and splits.random_binary(x, [1, 2]) is None


@pytest.mark.parametrize(("mean", "alpha", "beta"), [(3.5, 0.6, 2.0), (60.0, 4.0, 0.5)])
def test_poisson_and_gamma_draws(spark, mean, alpha, beta):
    rows = spark.range(20_000).select(F.lit(mean).alias("poisson_mean"), F.lit(alpha).alias("gamma_alpha"), F.lit(beta).alias("gamma_beta"))
    got = rows.select(parametric.draw("poisson", 3).alias("p"), parametric.draw("gamma", 3).alias("g")).agg(F.avg("p").alias("p"), F.var_pop("p").alias("vp"), F.avg("g").alias("g"), F.var_pop("g").alias("vg"), F.min("g").alias("low")).first()
    assert abs(got.p - mean) < 0.05 * mean and abs(got.vp - mean) < 0.08 * mean
    assert abs(got.g - alpha / beta) < 0.05 * alpha / beta and abs(got.vg - alpha / beta**2) < 0.1 * alpha / beta**2 and got.low > 0

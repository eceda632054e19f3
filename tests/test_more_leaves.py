import numpy as np
import pytest
from pyspark.sql import functions as F

from sievetree.functions import context, leaves
from sievetree.functions import more_leaves as ml
from sievetree.plans import join_model as jm


def test_context(spark):
    df = spark.createDataFrame([(1.5, 0, 3, None), (2.5, 1, 4, 1.0), (None, 1, 4, 1.0)], "a double, b int, c int, d double")
    got = {r.col: r for r in context.column_context(df, list("abcd")).collect()}
    assert [got[c].meta for c in "abcd"] == ["REAL", "BINARY", "DISCRETE", "BINARY"] and got["a"].n_null == 1
    assert context.column_context(df, ["a"], "COUNT").first().meta == "DISCRETE"
    assert context.column_context(df.where("false"), ["a"]).count() == 0
    bits = df.select(context.one_hot(F.col("c"), [3, 4]).alias("x")).collect()
    assert [r.x for r in bits] == [[1, 0], [0, 1], [0, 1]]
    assert df.select(context.one_hot(F.col("a"), [1.5, 2.5]).alias("x")).collect()[2].x == [0, 0]
    with pytest.raises(Exception, match="not in the domain"):
        df.select(context.one_hot(F.col("c"), [3])).collect()
    with pytest.raises(ValueError):
        context.prepared(F.col("a"), "cube")


def test_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 2)) @ np.array([[3.0, 1.0, 2.0], [0.1, 0.4, -0.2]])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    found = context.principal_components(df, list("abc"), 0.9)
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
    assert len(found) == 1 and abs(found[0][0] - value[-1] / value.sum()) < 1e-9
    assert np.allclose(np.abs(found[0][1]), np.abs(vector[:, -1]))
    assert len(context.principal_components(df, list("abc"), 1.0)) >= 2
    assert context.reduced(df, list("abc"), found).count() == 400


def test_term_weights(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (None, 0)], "a int, b int")
    rows = [tuple(r) for r in context.term_weights(df, ["a", "b"]).collect()]
    a, b = np.log(4 / 3) + 1, np.log(4 / 2) + 1
    assert np.allclose(rows, [(a, 0), (a / 4, 3 * b / 4), (0, 0)])


def test_joint_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 2)], "a int, b int")
    cells = leaves.joint_histogram(df, ["a", "b"])
    more = ml.update_joint(cells, cells, ["a", "b"])
    assert {(r.a, r.b): r.n for r in more.collect()} == {(1, 1): 4, (1, 2): 2}
    assert ml.update_joint(cells, cells, ["a", "b"], -1).count() == 0
    with pytest.raises(Exception, match="not in the leaf"):
        ml.update_joint(cells, more, ["a", "b"], -1).collect()


def test_range_draws_follow_the_leaf(spark):
    counts = spark.createDataFrame([("x", 1.0, 10), ("x", 2.0, 30), ("x", 3.0, 60), ("x", 9.0, 1000)], "col string, v double, n long")
    bins = leaves.histogram(counts, alpha=0.0)
    wanted = spark.range(3000).select(F.lit(0).alias("qid"), F.col("id").alias("i"), F.lit("x").alias("col"), F.lit(1.0).alias("lo"), F.lit(3.0).alias("hi"), F.rand(4).alias("u"))
    got = {r.v: r.n for r in ml.draws_in_range(bins, wanted).groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {1.0, 2.0, 3.0} and abs(got[3.0] / 3000 - 0.6) < 0.04
    assert ml.draws_in_range(bins, wanted.withColumn("lo", F.lit(4.0)).withColumn("hi", F.lit(5.0))).count() == 0


def test_densities_add_up_to_one(spark):
    rows = spark.range(400).select(F.col("id").cast("double").alias("x"))
    total = rows.agg(F.sum(ml.negative_binomial(F.col("x"), 3.0, 0.2)).alias("a"), F.sum(ml.hypergeometric(F.col("x"), 7, 20, 15)).alias("b")).first()
    assert abs(total.a - 1) < 1e-6 and abs(total.b - 1) < 1e-6


def test_cover_set():
    counts = [5, 5, 0.1, 9]
    scores = {(a, z): float(np.var(counts[a : z + 1])) for a in range(4) for z in range(a, 4)}
    assert ml.cover_set(scores) == [(0, 1), (2, 2), (3, 3)]
    assert ml.cover_set({(0, 0): 0.0}) == [(0, 0)]


def test_domain_table():
    assert jm.domain_table([["a"], ["a", "b"], ["a", "b"]], [3, 9, 7]) == 2

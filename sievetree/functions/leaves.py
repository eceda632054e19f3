"""Leaf distributions as rows: histograms with gap bins, point and range probability, expectation, inserts and deletes, fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Slices of a column's value range that running sums go by.
SLICES = 64


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, col, v, n), NULL values too, of all columns in one pass and one exchange."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")
    return df.select(*by, pairs).select(*by, "p.col", "p.v").groupBy(*by, "col", "v").agg(F.count("*").alias("n"))


def histogram(counts: DataFrame, domain: DataFrame | None = None, by: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """(by, col, lo, hi, n, pdf, cdf, non_null). A bin is a value; with a domain (col, v) a run of its values that are absent is one empty bin. Laplace smoothing by alpha. The windows run over distinct values of one column of one leaf, not over rows."""
    key = [*by, "col"]
    share = counts.groupBy(*key).agg((F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("non_null"))
    found = counts.where("v is not null")
    if domain is not None:
        leaves = found.select(*key).distinct()
        found = leaves.join(domain, "col").join(found, [*key, "v"], "left").select(*key, "v", F.coalesce("n", F.lit(0)).alias("n"))
    order = Window.partitionBy(*key).orderBy("v")
    starts = (F.col("n") > 0) | (F.coalesce(F.lag("n").over(order), F.lit(1)) > 0)
    bins = found.withColumn("bin", F.sum(starts.cast("int")).over(order)).groupBy(*key, "bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"))
    whole = Window.partitionBy(*key)
    bins = bins.withColumn("pdf", (F.col("n") + alpha) / (F.sum("n").over(whole) + alpha * F.count("*").over(whole)))
    return bins.withColumn("cdf", F.sum("pdf").over(Window.partitionBy(*key).orderBy("lo"))).join(share, key).select(*key, "lo", "hi", "n", "pdf", "cdf", "non_null")


def range_probability(bins: DataFrame, workload: DataFrame) -> DataFrame:
    """(qid, col, p): whole bins that the closed interval touches, times the share that is not NULL. A leaf's bins are bounded by its distinct values; queries meet only their own column's bins."""
    touched = (F.col("b.lo") <= F.col("q.hi")) & (F.col("b.hi") >= F.col("q.lo"))
    joined = workload.alias("q").join(bins.alias("b"), (F.col("q.col") == F.col("b.col")) & touched, "left")
    return joined.groupBy("q.qid", "q.col").agg(F.coalesce(F.sum(F.col("b.pdf") * F.col("b.non_null")), F.lit(0.0)).alias("p"))


def point_probability(bins: DataFrame, points: DataFrame) -> DataFrame:
    """(qid, col, p) of rows (qid, col, v): the bin's share, 0 outside."""
    return range_probability(bins, points.select("qid", "col", F.col("v").alias("lo"), F.col("v").alias("hi")))


def product(probabilities: DataFrame) -> DataFrame:
    """(qid, p): columns taken as independent."""
    zero = F.max((F.col("p") <= 0).cast("int"))
    return probabilities.groupBy("qid").agg(F.when(zero == 1, 0.0).otherwise(F.exp(F.sum(F.log(F.greatest("p", F.lit(5e-324)))))).alias("p"))


def joint_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Joint cells (the columns, n, pdf) of rows without NULL, not smoothed."""
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop().groupBy(*columns).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n")).first()[0] or 1
    return cells.select(*columns, "n", (F.col("n") / F.lit(total)).alias("pdf"))


def moment(bins: DataFrame, order: int = 1) -> DataFrame:
    """(col, value): E[x^order] over the bins, the middle of a bin standing for it."""
    return bins.groupBy("col").agg(F.sum(F.col("pdf") * F.pow((F.col("lo") + F.col("hi")) / 2, F.lit(order))).alias("value"))


def expectation(bins: DataFrame, lo: float | None = None, hi: float | None = None, low_in: bool = True, high_in: bool = True, power: int = 1) -> DataFrame:
    """(col, value): E[1{x in the interval} * x^power], power 1, 2, -1 or -2, with open or closed ends; NULLs count as outside."""
    x = (F.col("lo") + F.col("hi")) / 2
    inside: Column = F.lit(True)
    if lo is not None:
        inside = inside & ((x >= lo) if low_in else (x > lo))
    if hi is not None:
        inside = inside & ((x <= hi) if high_in else (x < hi))
    return bins.groupBy("col").agg(F.sum(F.when(inside & ((x != 0) | (F.lit(power) > 0)), F.col("pdf") * F.col("non_null") * F.pow(x, F.lit(power))).otherwise(0.0)).alias("value"))


def update(old: DataFrame, rows: DataFrame, sign: int = 1) -> DataFrame:
    """Counts (col, v, n) with those of rows inserted, or deleted with sign -1; deleting what is not there raises."""
    merged = old.select("col", "v", "n").unionByName(rows.select("col", "v", (F.col("n") * sign).alias("n"))).groupBy("col", "v").agg(F.sum("n").alias("n"))
    checked = F.when(F.col("n") < 0, F.raise_error(F.lit("a deleted value is not in the leaf")).cast("long")).otherwise(F.col("n"))
    return merged.withColumn("n", checked).where("n > 0")


def fit(df: DataFrame, column: str) -> DataFrame:
    """Maximum-likelihood parameters of the parametric leaves for one column, one row, one pass."""
    x = F.col(column).cast("double")
    positive = F.min(x) > 0
    mean, log_mean = F.avg(x), F.avg(F.when(x > 0, F.log(x)))
    s = F.log(mean) - log_mean
    shape = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)
    return df.agg(
        mean.alias("gaussian_mean"),
        F.greatest(F.stddev_pop(x), F.lit(1e-8)).alias("gaussian_stdev"),
        mean.alias("poisson_mean"),
        mean.alias("exponential_mean"),
        F.min(x).alias("uniform_start"),
        F.max(x).alias("uniform_end"),
        (1 / (F.max(x) - F.min(x))).alias("uniform_density"),
        F.when(positive, log_mean).alias("lognormal_mean"),
        F.when(positive, F.stddev_pop(F.when(x > 0, F.log(x)))).alias("lognormal_stdev"),
        (F.count(x) / F.sum(x)).alias("geometric_p"),
        F.avg((x > 0).cast("double")).alias("bernoulli_p"),
        F.when(positive, shape).otherwise(1.1).alias("gamma_alpha"),
        F.when(positive, shape / mean).otherwise(1.0).alias("gamma_beta"),
    )


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """(v, ecdf) of distinct values: the share of rows at or below. Counts are taken first; running sums are taken in two steps, within slices of the value range and over the slices, so no task has to see all values."""
    rows = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    cuts = sorted(set(rows.approxQuantile("v", [i / SLICES for i in range(1, SLICES)], 0.5 / SLICES)))
    part = F.array_size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < F.col("v"))) if cuts else F.lit(0)
    n = rows.groupBy("v").agg(F.count("*").alias("n")).withColumn("part", part)
    totals = n.groupBy("part").agg(F.sum("n").alias("own"))
    # One row for each slice.
    below = totals.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("below"), F.sum("own").over(Window.partitionBy()).alias("all"))
    order = Window.partitionBy("part").orderBy("v")
    return n.join(F.broadcast(below), "part").select("v", ((F.sum("n").over(order) + F.col("below")) / F.col("all")).alias("ecdf"))

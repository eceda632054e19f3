"""Further leaves as rows: piecewise-linear densities, conditional histograms, categorical and multivariate Gaussian leaves, slopes, modes, weighted fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import leaves


def piecewise(bins: DataFrame) -> DataFrame:
    """(col, x0, y0, x1, y1) of a density that is linear between the middles of a histogram's bins and has area 1. The window runs over the distinct values of one column. A column with one bin has no piece."""
    x = (F.col("lo") + F.col("hi")) / 2
    order = Window.partitionBy("col").orderBy("x0")
    points = bins.select("col", x.alias("x0"), F.col("pdf").alias("y0"))
    pieces = points.select("*", F.lead("x0").over(order).alias("x1"), F.lead("y0").over(order).alias("y1")).where("x1 is not null")
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y0") + F.col("y1")) / 2).over(Window.partitionBy("col"))
    return pieces.select("col", "x0", (F.col("y0") / area).alias("y0"), "x1", (F.col("y1") / area).alias("y1"))


def _height(x: Column, piece: str = "") -> Column:
    c = lambda name: F.col(f"{piece}{name}")
    return c("y0") + (c("y1") - c("y0")) * (x - c("x0")) / (c("x1") - c("x0"))


def piecewise_probability(pieces: DataFrame, workload: DataFrame) -> DataFrame:
    """(qid, col, p): the area under the pieces inside the interval. Pieces belong to a model, so a query meets its own column's only."""
    a, b = F.greatest(F.col("q.lo"), F.col("s.x0")), F.least(F.col("q.hi"), F.col("s.x1"))
    inside = (F.col("q.col") == F.col("s.col")) & (F.col("s.x0") <= F.col("q.hi")) & (F.col("s.x1") >= F.col("q.lo"))
    area = (b - a) * (_height(a, "s.") + _height(b, "s.")) / 2
    return workload.alias("q").join(pieces.alias("s"), inside, "left").groupBy("q.qid", "q.col").agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("p"))


def piecewise_density(pieces: DataFrame, points: DataFrame) -> DataFrame:
    """(qid, col, density, slope) of rows (qid, col, v); 0 outside. A point between two pieces belongs to the right one."""
    inside = (F.col("q.col") == F.col("s.col")) & (F.col("q.v") >= F.col("s.x0")) & (F.col("q.v") < F.col("s.x1"))
    slope = (F.col("s.y1") - F.col("s.y0")) / (F.col("s.x1") - F.col("s.x0"))
    return points.alias("q").join(pieces.alias("s"), inside, "left").select("q.qid", "q.col", F.coalesce(_height(F.col("q.v"), "s."), F.lit(0.0)).alias("density"), F.coalesce(slope, F.lit(0.0)).alias("slope"))


def piecewise_moment(pieces: DataFrame, order: int = 1) -> DataFrame:
    """(col, value): the integral of x^order times the density, exact for linear pieces."""
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    start = F.col("y0") - slope * F.col("x0")
    power = lambda k: (F.pow(F.col("x1"), F.lit(float(k))) - F.pow(F.col("x0"), F.lit(float(k)))) / k
    return pieces.groupBy("col").agg(F.sum(start * power(order + 1) + slope * power(order + 2)).alias("value"))


def piecewise_mode(pieces: DataFrame) -> DataFrame:
    """(col, mode): where the density is highest, the smallest of equals."""
    ends = pieces.select("col", F.explode(F.array(F.struct(F.col("y0").alias("y"), (-F.col("x0")).alias("minus")), F.struct(F.col("y1").alias("y"), (-F.col("x1")).alias("minus")))).alias("e"))
    return ends.groupBy("col").agg((-F.max("e")["minus"]).alias("mode"))


def mode(bins: DataFrame) -> DataFrame:
    """(col, mode): the middle of the heaviest bin, the smallest of equals."""
    top = F.max(F.struct("pdf", (-(F.col("lo") + F.col("hi")) / 2).alias("minus")))
    return bins.groupBy("col").agg((-top["minus"]).alias("mode"))


def slopes(bins: DataFrame) -> DataFrame:
    """(col, lo, slope): half the difference of the neighbouring bins' shares; outside the leaf they are 0."""
    order = Window.partitionBy("col").orderBy("lo")
    zero = F.lit(0.0)
    return bins.select("col", "lo", F.lead("pdf").over(order).alias("after"), F.lag("pdf").over(order).alias("before")).select("col", "lo", ((F.coalesce("after", zero) - F.coalesce("before", zero)) / 2).alias("slope"))


def conditional_histogram(df: DataFrame, column: str, condition: Column, alpha: float = 1.0) -> DataFrame:
    """(given, col, lo, hi, n, pdf, cdf, non_null): a histogram of the column in each part that `condition` makes."""
    counts = leaves.value_counts(df.select(condition.alias("given"), column), [column], ["given"])
    return leaves.histogram(counts, by=["given"], alpha=alpha)


def categorical(df: DataFrame, column: str) -> DataFrame:
    """(v, n, p) of the values that are not NULL."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return counts.select("v", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))


def in_list(shares: DataFrame, lists: DataFrame) -> DataFrame:
    """(qid, p) of rows (qid, values array): the share of the listed values, each once; values outside the leaf add 0."""
    asked = lists.select("qid", F.explode_outer(F.array_distinct("values")).alias("v"))
    return asked.join(shares, "v", "left").groupBy("qid").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("p"))


def gaussian(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, mean_i, mean_j, covariance) for i <= j of rows without NULL, in one pass; the covariance is the sample's."""
    x = [F.col(c).cast("double") for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.na.drop(subset=list(columns)).agg(*[F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.avg(x[i]).alias("mean_i"), F.avg(x[j]).alias("mean_j"), F.covar_samp(x[i], x[j]).alias("covariance")).alias(f"p{k}") for k, (i, j) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[f"p{k}" for k in range(len(pairs))])).alias("p")).select("p.*")


def weighted_fit(df: DataFrame, column: str, weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean, stdev, share_positive): the step of expectation-maximisation for Gaussian and Bernoulli leaves, rows counting by their weight."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(*by, x.alias("x"), weight.alias("w"))
    mean = F.sum(F.col("w") * F.col("x")) / F.sum("w")
    square = F.sum(F.col("w") * F.col("x") * F.col("x")) / F.sum("w")
    return rows.groupBy(*by).agg(mean.alias("mean"), F.greatest(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), F.lit(1e-8)).alias("stdev"), (F.sum(F.when(F.col("x") > 0, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share_positive"))


def mixture(df: DataFrame, column: str, parts: int = 2, rounds: int = 10) -> list[dict[str, float]]:
    """Weights, means and deviations of a mixture of Gaussians by expectation-maximisation; a round is one aggregation over all rows, and only the parameters reach the driver."""
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).where("x is not null")
    first = rows.agg(F.percentile_approx("x", [(2 * i + 1) / (2 * parts) for i in range(parts)]).alias("at"), F.stddev_pop("x").alias("s")).first()
    if first["at"] is None:
        return []
    now = [{"weight": 1 / parts, "mean": m, "stdev": max(first["s"], 1e-8)} for m in first["at"]]
    for _ in range(rounds):
        # The largest exponent is taken out, so that far rows still belong to their nearest part.
        logs = [F.lit(float(_log(p["weight"]) - _log(p["stdev"]))) - F.pow((F.col("x") - p["mean"]) / p["stdev"], F.lit(2.0)) / 2 for p in now]
        top = F.greatest(*logs) if parts > 1 else logs[0]
        shares = [F.exp(v - top) for v in logs]
        whole = sum(shares[1:], shares[0])
        own = rows.select("x", *[(s / whole).alias(f"w{i}") for i, s in enumerate(shares)])
        sums = own.agg(*[f for i in range(parts) for f in (F.sum(f"w{i}").alias(f"n{i}"), F.sum(F.col(f"w{i}") * F.col("x")).alias(f"s{i}"), F.sum(F.col(f"w{i}") * F.col("x") * F.col("x")).alias(f"q{i}"))]).first()
        total = sum(sums[f"n{i}"] for i in range(parts))
        now = []
        for i in range(parts):
            n = max(sums[f"n{i}"], 1e-12)
            mean = sums[f"s{i}"] / n
            now.append({"weight": n / total, "mean": mean, "stdev": max(max(sums[f"q{i}"] / n - mean * mean, 0.0) ** 0.5, 1e-8)})
    return now


def _log(v: float) -> float:
    return math.log(max(v, 1e-300))


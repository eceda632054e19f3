"""Further leaves: binary and joint binary, merged, joint cells asked and updated, counts without a fit, draws and distinct values in a range,
moments of the parametric leaves, gradients by feature; entropies of value intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .parametric import log_gamma

#: Fixed value: the machine epsilon of doubles, below which a binary leaf's probabilities do not go.
EPSILON = 2.0**-52


def binary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, p0, p1) of columns of 0 and 1, each at least EPSILON; NULLs are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")
    share = df.select(pairs).select("p.*").groupBy("col").agg(F.avg("v").alias("p1"))
    return share.select("col", F.greatest(1 - F.col("p1"), F.lit(EPSILON)).alias("p0"), F.greatest("p1", F.lit(EPSILON)).alias("p1"))


def joint_binary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(the columns, p) of each combination of 0 and 1 that there is; rows with a NULL are left out."""
    cells = df.select(*[F.col(c).cast("int").alias(c) for c in columns]).na.drop().groupBy(*columns).agg(F.count("*").alias("n"))
    return cells.select(*columns, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))


def joint_points(cells: DataFrame, points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(qid, p) of points (qid, the columns): the share of their cell, 0 without one. cells: of leaves.joint_histogram."""
    found = points.alias("q").join(cells.alias("c"), [F.col(f"q.{c}") == F.col(f"c.{c}") for c in columns], "left")
    return found.select("q.qid", F.coalesce("c.pdf", F.lit(0.0)).alias("p"))


def joint_ranges(cells: DataFrame, workload: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(qid, p) of queries (qid, col, lo, hi): the share of cells that are inside in all columns asked. A cell counts how many of a query's columns it meets."""
    asked = workload.where(F.col("col").isin(list(columns))).groupBy("qid").agg(F.count("*").alias("k"))
    long = cells.select("pdf", F.xxhash64(*columns).alias("cell"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("v")) for c in columns])).alias("p")).select("pdf", "cell", "p.*")
    met = workload.alias("w").join(long.alias("l"), (F.col("w.col") == F.col("l.col")) & F.col("l.v").between(F.col("w.lo"), F.col("w.hi")))
    met = met.groupBy("w.qid", "l.cell").agg(F.count("*").alias("met"), F.first("l.pdf").alias("pdf"))
    return asked.join(met, "qid", "left").groupBy("qid").agg(F.coalesce(F.sum(F.when(F.col("met") == F.col("k"), F.col("pdf"))), F.lit(0.0)).alias("p"))


def update_joint(cells: DataFrame, rows: DataFrame, columns: Sequence[str], sign: int = 1) -> DataFrame:
    """Joint cells (the columns, n, pdf) with those of rows (the columns, n) inserted, or deleted with sign -1; deleting what is not there raises. A merged leaf is updated part by part."""
    both = cells.select(*columns, "n").unionByName(rows.select(*columns, (F.col("n") * sign).alias("n"))).groupBy(*columns).agg(F.sum("n").alias("n"))
    checked = F.when(F.col("n") < 0, F.raise_error(F.lit("a deleted cell is not in the leaf")).cast("long")).otherwise(F.col("n"))
    both = both.withColumn("n", checked).where("n > 0")
    return both.withColumn("pdf", F.col("n") / F.sum("n").over(Window.partitionBy()))


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    """(qid, p): the product of several leaves' (qid, p), without logarithms of 0; a leaf that a query does not ask counts 1."""
    every = parts[0].select("qid", "p")
    for p in parts[1:]:
        every = every.unionByName(p.select("qid", "p"))
    none = F.max((F.col("p") <= 0).cast("int")) == 1
    return every.groupBy("qid").agg(F.when(none, 0.0).otherwise(F.exp(F.sum(F.log(F.greatest("p", F.lit(5e-324)))))).alias("p"))


def negative_binomial(x: Column, n: float, p: float) -> Column:
    """The chance of x failures before the n-th success."""
    whole = (x == F.floor(x)) & (x >= 0)
    log = log_gamma(x + n) - log_gamma(F.lit(float(n))) - log_gamma(x + 1) + n * F.log(F.lit(p)) + x * F.log1p(F.lit(-p))
    return F.when(x.isNull(), 1.0).when(whole, F.exp(log)).otherwise(0.0)


def hypergeometric(x: Column, good: int, total: int, drawn: int) -> Column:
    """The chance of x good ones among `drawn` of `total`, `good` of which are good."""
    choose = lambda a, b: log_gamma(a + 1) - log_gamma(b + 1) - log_gamma(a - b + 1)
    inside = (x == F.floor(x)) & x.between(max(0, drawn + good - total), min(good, drawn))
    lit = lambda v: F.lit(float(v))
    log = choose(lit(good), x) + choose(lit(total - good), drawn - x) - choose(lit(total), lit(drawn))
    return F.when(x.isNull(), 1.0).when(inside, F.exp(log)).otherwise(0.0)


def distinct_in_range(bins: DataFrame, workload: DataFrame) -> DataFrame:
    """(qid, col, v): a column's values inside each query's range, of the leaf's bins that hold rows."""
    inside = (F.col("b.col") == F.col("q.col")) & F.col("b.lo").between(F.col("q.lo"), F.col("q.hi"))
    return workload.alias("q").join(bins.where("n > 0 and lo = hi").alias("b"), inside).select("q.qid", "q.col", F.col("b.lo").alias("v")).distinct()


def distinct_in_list(shares: DataFrame, lists: DataFrame) -> DataFrame:
    """(qid, v): a categorical leaf's values (v, n) that each query's list (qid, vs) names."""
    asked = lists.select("qid", F.explode("vs").alias("v")).distinct()
    return asked.join(shares.where("n > 0").select("v"), "v").select("qid", "v")


def draws_in_range(bins: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, i, v) of rows (qid, i, col, lo, hi, u): for u in [0, 1) the value at which the leaf's distribution inside the range reaches u (inverse distribution function). Uniform random u give a sample. A range without rows has no draw. The window sees a leaf's bins of one query."""
    ranges = wanted.select("qid", "col", "lo", "hi").distinct()
    inside = (F.col("b.col") == F.col("q.col")) & F.col("b.lo").between(F.col("q.lo"), F.col("q.hi"))
    own = ranges.alias("q").join(bins.where("lo = hi").alias("b"), inside).select("q.qid", "q.col", F.col("b.lo").alias("v"), "b.pdf")
    order = Window.partitionBy("qid", "col").orderBy("v")
    whole = F.sum("pdf").over(Window.partitionBy("qid", "col"))
    steps = own.select("qid", "col", "v", (F.sum("pdf").over(order) / whole).alias("to"), ((F.sum("pdf").over(order) - F.col("pdf")) / whole).alias("at"))
    last = steps.withColumn("to", F.when(F.row_number().over(Window.partitionBy("qid", "col").orderBy(F.desc("v"))) == 1, F.lit(2.0)).otherwise(F.col("to")))
    hit = (F.col("w.qid") == F.col("s.qid")) & (F.col("w.col") == F.col("s.col")) & (F.col("w.u") >= F.col("s.at")) & (F.col("w.u") < F.col("s.to"))
    return wanted.alias("w").join(last.alias("s"), hit).groupBy("w.qid", "w.i").agg(F.min("s.v").alias("v"))


def parametric_moments(fits: DataFrame) -> DataFrame:
    """One row: the mean and the second moment of each family, in closed form over the parameters of leaves.fit."""
    p = F.col
    mean = {
        "gaussian": p("gaussian_mean"),
        "poisson": p("poisson_mean"),
        "exponential": p("exponential_mean"),
        "uniform": (p("uniform_start") + p("uniform_end")) / 2,
        "lognormal": F.exp(p("lognormal_mean") + p("lognormal_stdev") * p("lognormal_stdev") / 2),
        "geometric": 1 / p("geometric_p"),
        "bernoulli": p("bernoulli_p"),
        "gamma": p("gamma_alpha") / p("gamma_beta"),
    }
    second = {
        "gaussian": p("gaussian_mean") * p("gaussian_mean") + p("gaussian_stdev") * p("gaussian_stdev"),
        "poisson": p("poisson_mean") * (p("poisson_mean") + 1),
        "exponential": 2 * p("exponential_mean") * p("exponential_mean"),
        "uniform": (p("uniform_start") * p("uniform_start") + p("uniform_start") * p("uniform_end") + p("uniform_end") * p("uniform_end")) / 3,
        "lognormal": F.exp(2 * p("lognormal_mean") + 2 * p("lognormal_stdev") * p("lognormal_stdev")),
        "geometric": (2 - p("geometric_p")) / (p("geometric_p") * p("geometric_p")),
        "bernoulli": p("bernoulli_p"),
        "gamma": p("gamma_alpha") * (p("gamma_alpha") + 1) / (p("gamma_beta") * p("gamma_beta")),
    }
    return fits.select(*[v.alias(f"{k}_mean") for k, v in mean.items()], *[v.alias(f"{k}_second") for k, v in second.items()])


def feature_gradients(pieces: DataFrame, points: DataFrame) -> DataFrame:
    """(qid, col, gradient): the derivative of a row's density by each of its values, for independent columns of piecewise-linear density: the slope there times the other columns' densities. points: (qid, col, v); pieces: of densities.piecewise."""
    inside = (F.col("q.col") == F.col("p.col")) & (F.col("q.v") >= F.col("p.x0")) & (F.col("q.v") < F.col("p.x1"))
    slope = (F.col("p.y1") - F.col("p.y0")) / (F.col("p.x1") - F.col("p.x0"))
    there = points.alias("q").join(pieces.alias("p"), inside, "left").select("q.qid", "q.col", F.coalesce(slope, F.lit(0.0)).alias("slope"), F.coalesce(F.col("p.y0") + slope * (F.col("q.v") - F.col("p.x0")), F.lit(0.0)).alias("y"))
    row = Window.partitionBy("qid")
    zeros = F.sum((F.col("y") <= 0).cast("int")).over(row) - (F.col("y") <= 0).cast("int")
    logs = F.sum(F.when(F.col("y") > 0, F.log("y")).otherwise(0.0)).over(row) - F.when(F.col("y") > 0, F.log("y")).otherwise(0.0)
    return there.select("qid", "col", F.when(zeros > 0, 0.0).otherwise(F.col("slope") * F.exp(logs)).alias("gradient"))


def interval_entropies(counts: DataFrame, most: int = 2000) -> DataFrame:
    """(lo, hi, n, entropy) of every interval of a column's values (v, n): the entropy in bits of its rows by value. For at most `most` distinct values, as there are most*(most+1)/2 intervals; more raise."""
    if counts.count() > most:
        raise ValueError(f"over {most} distinct values: bin them first")
    order = Window.orderBy("v")
    own = counts.select("v", F.col("n").cast("double").alias("n"), (F.col("n") * F.log2("n")).alias("t"))
    own = own.select("v", "n", F.sum("n").over(order).alias("s"), "t", F.sum("t").over(order).alias("u"))
    a, b = own.alias("a"), F.broadcast(own).alias("b")
    n, t = F.col("b.s") - F.col("a.s") + F.col("a.n"), F.col("b.u") - F.col("a.u") + F.col("a.t")
    return a.join(b, F.col("a.v") <= F.col("b.v")).select(F.col("a.v").alias("lo"), F.col("b.v").alias("hi"), n.cast("long").alias("n"), (F.log2(n) - t / n).alias("entropy"))


def cover_set(scores: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """A cover of the places 0 to k by disjoint intervals, from scores of all intervals (first, last), 0 best: single places are merged two neighbours at a time, always the pair whose merged score is least above its parts', while that does not raise the total."""
    last = max(z for _, z in scores)
    cover = [(i, i) for i in range(last + 1)]
    while len(cover) > 1:
        gain = [(scores[a, z] - scores[a, b] - scores[c, z], i) for i, ((a, b), (c, z)) in enumerate(zip(cover[:-1], cover[1:], strict=True))]
        best, i = min(gain)
        if best > 0:
            break
        cover[i : i + 2] = [(cover[i][0], cover[i + 1][1])]
    return cover


def dominance(rows: Column) -> Column:
    """How far a bucket's commonest key stands out, from the rows of a table. The two coefficients."""
    return F.greatest(F.lit(1.0), F.lit(48.37) - F.lit(4.359) * F.log(rows))

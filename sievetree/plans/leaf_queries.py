"""Registered queries of column contexts and the further leaves, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import context, densities, leaves
from ..functions import more_leaves as ml
from . import join_model as jm
from .queries import _BINS, _BUCKETS, _DUCK, _add, _bins, _buckets, _table, range_workload
from .structure_queries import _PIECES, _rounded

_CONTEXT = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_linenumber": "l_linenumber", "is_open": "CAST(l_linestatus = 'O' AS INT)", "some_tax": "nullif(l_tax, 0)"}


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr("CAST(l_linestatus = 'O' AS INT) AS a", "CAST(l_returnflag = 'R' AS INT) AS b", "CAST(l_quantity > 25 AS INT) AS c", "0 AS d")


@_add(
    "WITH l AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({e} AS DOUBLE) AS v FROM lineitem" for c, e in _CONTEXT.items())
    + ") SELECT col, CASE WHEN min(CAST(v = floor(v) AS INT)) = 1 THEN CASE WHEN min(v) >= 0 AND max(v) <= 1 THEN 'BINARY' ELSE 'DISCRETE' END ELSE 'REAL' END AS meta, min(v) AS lo, max(v) AS hi, count(DISTINCT v) AS n_distinct, CAST(count(*) - count(v) AS BIGINT) AS n_null, count(DISTINCT v) <= 1200 AS groupable FROM l GROUP BY col"
)
def column_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _CONTEXT.items()])
    return context.column_context(rows, list(_CONTEXT))


@_add(
    """WITH c AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_extendedprice / 1000, l_extendedprice / 1000) AS d, covar_pop(l_quantity, l_extendedprice / 1000) AS b FROM lineitem),
e AS (SELECT (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS big, a + d AS whole FROM c)
SELECT 0::BIGINT AS k, round(big / whole, 8) AS share FROM e UNION ALL SELECT 1, round(1 - big / whole, 8) FROM e"""
)
def pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_quantity", "l_extendedprice / 1000 AS price")
    found = context.principal_components(rows, ["l_quantity", "price"], 1.0)
    return spark.createDataFrame([(k, round(share, 8)) for k, (share, _) in enumerate(found)], "k long, share double")


@_add("SELECT l_linestatus, CAST(sum(CAST(l_returnflag = 'A' AS INT)) AS BIGINT) AS a, CAST(sum(CAST(l_returnflag = 'N' AS INT)) AS BIGINT) AS n, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS r FROM lineitem GROUP BY l_linestatus")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = _table(spark, sf_dir, "lineitem").select("l_linestatus", context.one_hot(F.col("l_returnflag"), ["A", "N", "R"]).alias("bits"))
    return bits.groupBy("l_linestatus").agg(*[F.sum(F.col("bits")[i]).alias(c) for i, c in enumerate("anr")])


@_add("SELECT l_linenumber, round(sum(ln(1 + l_quantity)), 4) AS logs, round(sum(sqrt(l_extendedprice)), 2) AS roots, round(sum(l_tax), 4) AS plain FROM lineitem GROUP BY l_linenumber")
def prepared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    total = lambda c, how, digits, name: F.round(F.sum(context.prepared(F.col(c), how)), digits).alias(name)
    return li.groupBy("l_linenumber").agg(total("l_quantity", "log1p", 4, "logs"), total("l_extendedprice", "sqrt", 2, "roots"), total("l_tax", None, 4, "plain"))


_POINTS = "SELECT CAST(range AS BIGINT) AS qid, CAST(range % 13 AS DOUBLE) / 100 AS l_discount, CAST(range % 10 AS DOUBLE) / 100 AS l_tax FROM range(60)"


@_add(f"WITH q AS ({_POINTS}), c AS (SELECT CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT qid, round(coalesce(n / CAST((SELECT count(*) FROM lineitem) AS DOUBLE), 0), 9) AS p FROM q LEFT JOIN c ON d = q.l_discount AND t = q.l_tax")
def joint_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = leaves.joint_histogram(_table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"])
    points = spark.range(60).selectExpr("id AS qid", "CAST(id % 13 AS DOUBLE) / 100 AS l_discount", "CAST(id % 10 AS DOUBLE) / 100 AS l_tax")
    return _rounded(ml.joint_points(cells, points, ["l_discount", "l_tax"]), 9, "p")


@_add(
    f"""{_DUCK}, q AS (SELECT qid, max(lo) FILTER (WHERE col = 'l_quantity') AS ql, max(hi) FILTER (WHERE col = 'l_quantity') AS qh, max(lo) FILTER (WHERE col = 'l_linenumber') AS nl, max(hi) FILTER (WHERE col = 'l_linenumber') AS nh FROM w GROUP BY qid),
c AS (SELECT l_quantity AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT qid, round(coalesce(sum(n), 0) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE), 9) AS p FROM q LEFT JOIN c ON (ql IS NULL OR a BETWEEN ql AND qh) AND (nl IS NULL OR b BETWEEN nl AND nh) WHERE ql IS NOT NULL OR nl IS NOT NULL GROUP BY qid"""
)
def joint_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = leaves.joint_histogram(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"])
    return _rounded(ml.joint_ranges(cells, range_workload(spark), ["l_quantity", "l_linenumber"]), 9, "p")


@_add(
    """WITH r AS (SELECT l_discount, l_tax, 1 AS s FROM lineitem UNION ALL SELECT l_discount, l_tax, 1 FROM lineitem WHERE l_quantity <= 5 UNION ALL SELECT l_discount, l_tax, -1 FROM lineitem WHERE l_quantity > 40),
c AS (SELECT CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax, CAST(sum(s) AS BIGINT) AS n FROM r GROUP BY 1, 2 HAVING sum(s) > 0) SELECT *, round(n / sum(n) OVER (), 9) AS pdf FROM c"""
)
def joint_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, both = _table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"]
    cells = ml.update_joint(leaves.joint_histogram(li, both), leaves.joint_histogram(li.where("l_quantity <= 5"), both), both)
    return _rounded(ml.update_joint(cells, leaves.joint_histogram(li.where("l_quantity > 40"), both), both, -1), 9, "pdf")


@_add(f"{_DUCK}, {_BINS}, p AS (SELECT qid, w.col, sum(pdf) AS p FROM w JOIN b ON w.col = b.col AND b.v <= w.hi AND b.v >= w.lo WHERE w.col IN ('l_tax', 'l_discount') GROUP BY qid, w.col) SELECT qid, round(product(p), 9) AS p FROM p GROUP BY qid")
def merged_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins, w = _bins(spark, sf_dir), range_workload(spark)
    return _rounded(ml.merged([leaves.range_probability(bins.where(F.col("col") == c), w.where(F.col("col") == c)) for c in ("l_tax", "l_discount")]), 9, "p")


@_add(
    "WITH l AS (SELECT 'a' AS col, avg(CAST(l_linestatus = 'O' AS INT)) AS p FROM lineitem UNION ALL SELECT 'b', avg(CAST(l_returnflag = 'R' AS INT)) FROM lineitem UNION ALL SELECT 'c', avg(CAST(l_quantity > 25 AS INT)) FROM lineitem UNION ALL SELECT 'd', 0) SELECT col, round(greatest(1 - p, 2.220446049250313e-16), 12) AS p0, round(greatest(p, 2.220446049250313e-16), 12) AS p1, p = 0 AS never FROM l"
)
def binary_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ml.binary(_flags(spark, sf_dir), list("abcd"))
    return _rounded(found.withColumn("never", F.col("p1") <= 2 * ml.EPSILON), 12, "p0", "p1")


@_add("WITH f AS (SELECT CAST(l_linestatus = 'O' AS INT) AS a, CAST(l_returnflag = 'R' AS INT) AS b, CAST(l_quantity > 25 AS INT) AS c FROM lineitem) SELECT a, b, c, round(count(*) / CAST((SELECT count(*) FROM f) AS DOUBLE), 9) AS p FROM f GROUP BY a, b, c")
def joint_binary_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ml.joint_binary(_flags(spark, sf_dir), list("abc")), 9, "p")


@_add(
    """WITH q AS (SELECT CAST(range AS DOUBLE) AS x FROM range(0, 25))
SELECT x, round(exp(lgamma(x + 4.5) - lgamma(4.5) - lgamma(x + 1) + 4.5 * ln(0.35) + x * ln(0.65)), 7) AS negative_binomial,
CASE WHEN x BETWEEN 0 AND 10 THEN round(exp(lgamma(13) - lgamma(x + 1) - lgamma(13 - x) + lgamma(29) - lgamma(11 - x) - lgamma(19 + x) - lgamma(41) + lgamma(11) + lgamma(31)), 7) ELSE 0 END AS hypergeometric FROM q"""
)
def counting_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    rows = spark.range(25).select(F.col("id").cast("double").alias("x"))
    return rows.select("x", F.round(ml.negative_binomial(x, 4.5, 0.35), 7).alias("negative_binomial"), F.round(ml.hypergeometric(x, 12, 40, 10), 7).alias("hypergeometric"))


@_add(f"{_DUCK}, {_BINS} SELECT DISTINCT qid, w.col, v FROM w JOIN b ON w.col = b.col AND v BETWEEN w.lo AND w.hi")
def distinct_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.distinct_in_range(_bins(spark, sf_dir), range_workload(spark))


@_add("WITH q AS (SELECT * FROM (VALUES (0::BIGINT, ['BUILDING', 'MACHINERY', 'BUILDING']), (1, ['nothing']), (2, ['AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE'])) t(qid, vs)) SELECT DISTINCT qid, v FROM (SELECT qid, unnest(vs) AS v FROM q) u WHERE v IN (SELECT c_mktsegment FROM customer)")
def distinct_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("v")).agg(F.count("*").alias("n"))
    lists = spark.createDataFrame([(0, ["BUILDING", "MACHINERY", "BUILDING"]), (1, ["nothing"]), (2, ["AUTOMOBILE", "HOUSEHOLD", "FURNITURE"])], "qid long, vs array<string>")
    return ml.distinct_in_list(shares, lists)


@_add(
    f"""WITH {_BINS}, q AS (SELECT CAST(range AS BIGINT) AS i, CAST(range AS DOUBLE) / 40 + 0.0125 AS u FROM range(40)),
s AS (SELECT v, sum(pdf) OVER (ORDER BY v) / sum(pdf) OVER () AS t FROM b WHERE col = 'l_quantity' AND v BETWEEN 8 AND 31) SELECT 0::BIGINT AS qid, i, min(v) AS v FROM q JOIN s ON u < t GROUP BY i"""
)
def draws_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(40).selectExpr("0L AS qid", "id AS i", "'l_quantity' AS col", "8D AS lo", "31D AS hi", "CAST(id AS DOUBLE) / 40 + 0.0125D AS u")
    return ml.draws_in_range(_bins(spark, sf_dir), wanted)


@_add(
    """WITH f AS (SELECT avg(x) AS m, stddev_pop(x) AS s, min(x) AS a, max(x) AS z, avg(ln(x)) AS lm, stddev_pop(ln(x)) AS ls, count(x) / sum(x) AS g FROM (SELECT CAST(l_quantity AS DOUBLE) AS x FROM lineitem) t)
SELECT round(m, 6) AS gaussian_mean, round(m * m + s * s, 5) AS gaussian_second, round(m, 6) AS poisson_mean, round(m * (m + 1), 5) AS poisson_second, round(2 * m * m, 5) AS exponential_second, round((a + z) / 2, 6) AS uniform_mean, round((a * a + a * z + z * z) / 3, 5) AS uniform_second, round(exp(lm + ls * ls / 2), 5) AS lognormal_mean, round(1 / g, 6) AS geometric_mean FROM f"""
)
def parametric_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ml.parametric_moments(leaves.fit(_table(spark, sf_dir, "lineitem"), "l_quantity"))
    digits = {"gaussian_mean": 6, "gaussian_second": 5, "poisson_mean": 6, "poisson_second": 5, "exponential_second": 5, "uniform_mean": 6, "uniform_second": 5, "lognormal_mean": 5, "geometric_mean": 6}
    return found.select(*[F.round(c, d).alias(c) for c, d in digits.items()])


@_add(
    f"""WITH {_PIECES}, q AS (SELECT CAST(range AS BIGINT) AS qid, 'l_quantity' AS col, CAST(range AS DOUBLE) + 0.25 AS v FROM range(60) UNION ALL SELECT CAST(range AS BIGINT), 'l_tax', CAST(range % 8 AS DOUBLE) / 100 + 0.003 FROM range(60)),
y AS (SELECT qid, q.col, coalesce(y0 + (y1 - y0) * (v - x0) / (x1 - x0), 0) AS y, coalesce((y1 - y0) / (x1 - x0), 0) AS d FROM q LEFT JOIN pc ON pc.col = q.col AND v >= x0 AND v < x1)
SELECT a.qid, a.col, round(a.d * b.y, 6) + 0.0 AS gradient FROM y a JOIN y b ON a.qid = b.qid AND a.col <> b.col"""
)
def feature_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.range(60).selectExpr("id AS qid", "'l_quantity' AS col", "CAST(id AS DOUBLE) + 0.25D AS v").unionAll(spark.range(60).selectExpr("id AS qid", "'l_tax' AS col", "CAST(id % 8 AS DOUBLE) / 100 + 0.003D AS v"))
    found = ml.feature_gradients(densities.piecewise(_bins(spark, sf_dir)), points)
    return found.withColumn("gradient", F.round("gradient", 6) + F.lit(0.0))  # no negative zero


@_add(
    """WITH c AS (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), i AS (SELECT a.v AS lo, b.v AS hi FROM c a JOIN c b ON a.v <= b.v)
SELECT lo, hi, CAST(sum(n) AS BIGINT) AS n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 7) + 0.0 AS entropy FROM i JOIN c ON c.v BETWEEN lo AND hi GROUP BY lo, hi"""
)
def interval_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("double").alias("v")).agg(F.count("*").alias("n"))
    return ml.interval_entropies(counts).withColumn("entropy", F.round("entropy", 7) + F.lit(0.0))  # no negative zero


@_add("SELECT l_linenumber, round(greatest(1.0, 48.37 - 4.359 * ln(CAST(count(*) AS DOUBLE))), 9) AS dominance FROM lineitem GROUP BY l_linenumber")
def bucket_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").cast("double").alias("n"))
    return counts.select("l_linenumber", F.round(ml.dominance(F.col("n")), 9).alias("dominance"))


@_add(
    f"""WITH e AS (SELECT min(l_orderkey) AS lo_o, max(l_orderkey) AS hi_o, min(l_partkey) AS lo_p, max(l_partkey) AS hi_p FROM lineitem),
l AS (SELECT floor((l_orderkey - lo_o) / (hi_o - lo_o + 1.0) * 20)::BIGINT AS o, floor((l_partkey - lo_p) / (hi_p - lo_p + 1.0) * 20)::BIGINT AS p, l_orderkey AS k, l_partkey AS j, count(*) AS n FROM lineitem, e GROUP BY ALL),
lb AS (SELECT o, p, CAST(sum(n) AS DOUBLE) AS n, max(n) AS m FROM l GROUP BY o, p),
ob AS (SELECT floor((o_orderkey - lo_o) / (hi_o - lo_o + 1.0) * 20)::BIGINT AS o, count(*)::DOUBLE AS n FROM orders, e WHERE o_orderkey BETWEEN lo_o AND hi_o GROUP BY 1),
pb AS (SELECT floor((p_partkey - lo_p) / (hi_p - lo_p + 1.0) * 20)::BIGINT AS p, count(*)::DOUBLE AS n FROM part, e WHERE p_partkey BETWEEN lo_p AND hi_p GROUP BY 1)
SELECT lb.o AS bucket_o, lb.p AS bucket_p, round(lb.m * least(lb.n / lb.m, ob.n, pb.n), 6) AS estimate FROM lb JOIN ob ON lb.o = ob.o JOIN pb ON lb.p = pb.p"""
)
def eliminated_key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elimination over two keys: lineitem's buckets of (order, part) with those of orders and of part."""
    li = _table(spark, sf_dir, "lineitem")
    ends = li.agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b"), F.min("l_partkey").alias("c"), F.max("l_partkey").alias("d")).first()
    one = lambda df, keys: jm.bucket_stats_by(df, keys, 20)
    orders = _table(spark, sf_dir, "orders").where(F.col("o_orderkey").between(ends.a, ends.b))
    part = _table(spark, sf_dir, "part").where(F.col("p_partkey").between(ends.c, ends.d))
    lists = [one(li, {"bucket_o": ("l_orderkey", ends.a, ends.b), "bucket_p": ("l_partkey", ends.c, ends.d)}), one(orders, {"bucket_o": ("o_orderkey", ends.a, ends.b)}), one(part, {"bucket_p": ("p_partkey", ends.c, ends.d)})]
    return _rounded(jm.eliminate_by(lists).select("bucket_o", "bucket_p", F.col("bound").alias("estimate")), 6, "estimate")


@_add(
    f"""WITH {_BINS}, p AS (SELECT product(p) AS p FROM (SELECT col, sum(pdf) AS p FROM b WHERE (col = 'l_quantity' AND v BETWEEN 3 AND 10) OR (col = 'l_tax' AND v <= 0.045) GROUP BY col) t),
x AS ({_BUCKETS.format(k="l_orderkey", t="lineitem")}), y AS ({_BUCKETS.format(k="o_orderkey", t="orders")})
SELECT round(sum(x.mcv_n * p.p * y.mcv_n * least(x.n / CAST(x.mcv_n AS DOUBLE), y.n / CAST(y.mcv_n AS DOUBLE))), 4) AS estimate FROM x JOIN y ON x.bucket = y.bucket, p"""
)
def whole_table_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, filtered, with orders: the filter's selectivity from leaves of the whole table, the join from bucket lists."""
    asked = spark.createDataFrame([(0, "l_quantity", 3.0, 10.0), (0, "l_tax", 0.0, 0.045)], "qid long, col string, lo double, hi double")
    p = leaves.product(leaves.range_probability(_bins(spark, sf_dir), asked)).first().p
    parts = [(_buckets(spark, sf_dir, "lineitem", "l_orderkey"), p), (_buckets(spark, sf_dir, "orders", "o_orderkey"), 1.0)]
    return _rounded(jm.whole_table_estimate(parts), 4, "estimate")

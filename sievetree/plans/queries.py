"""Registered queries of the estimator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import leaves
from ..operators import dependence as dep
from ..operators import workload_stats as ws
from ..sources import tables, workload
from . import join_model as jm
from .tree import Model

COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The workload of range queries on lineitem: 60 queries of three patterns, the same rows in SQL and in Spark.
_WORKLOAD_SQL = """
w AS (SELECT i AS qid, 'l_quantity' AS col, CAST(i % 40 + 1 AS DOUBLE) AS lo, CAST(i % 40 + 6 + i % 7 AS DOUBLE) AS hi FROM r WHERE i % 3 < 2
 UNION ALL SELECT i, 'l_tax', CAST(0 AS DOUBLE), CAST((i % 8 + 1) AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.001 AS DOUBLE) FROM r WHERE i % 3 = 0
 UNION ALL SELECT i, 'l_discount', CAST((i % 6) AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(0.001 AS DOUBLE), CAST((i % 6 + 3) AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.001 AS DOUBLE) FROM r WHERE i % 3 > 0
 UNION ALL SELECT i, 'l_linenumber', CAST(1 AS DOUBLE), CAST(i % 7 + 1 AS DOUBLE) FROM r WHERE i % 5 = 0)"""
_DUCK = "WITH r AS (SELECT CAST(range AS BIGINT) AS i FROM range(60)), " + _WORKLOAD_SQL.strip()


def range_workload(spark: SparkSession) -> DataFrame:
    return spark.sql("WITH r AS (SELECT id AS i FROM range(60)), " + _WORKLOAD_SQL + " SELECT CAST(qid AS BIGINT) AS qid, col, lo, hi FROM w")


_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in COLUMNS) + ")"
_BINS = _LONG + ", c AS (SELECT col, v, count(*) AS n FROM l GROUP BY col, v), b AS (SELECT col, v, n, CAST(n + 1 AS DOUBLE) / (sum(n) OVER (PARTITION BY col) + count(*) OVER (PARTITION BY col)) AS pdf FROM c)"


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves.histogram(leaves.value_counts(_table(spark, sf_dir, "lineitem"), COLUMNS))


@_add(f"WITH {_BINS} SELECT col, v AS lo, n, round(pdf, 9) AS pdf, round(sum(pdf) OVER (PARTITION BY col ORDER BY v), 7) AS cdf FROM b")
def hist_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir).select("col", "lo", "n", F.round("pdf", 9).alias("pdf"), F.round("cdf", 7).alias("cdf"))


@_add(
    """WITH d AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS v FROM lineitem), s AS (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) AS n FROM lineitem WHERE l_quantity <= 10 OR l_quantity BETWEEN 20 AND 25 GROUP BY 1),
j AS (SELECT d.v, coalesce(n, 0) AS n FROM d LEFT JOIN s ON d.v = s.v), f AS (SELECT v, n, CASE WHEN n > 0 OR coalesce(lag(n) OVER (ORDER BY v), 1) > 0 THEN 1 ELSE 0 END AS st FROM j),
g AS (SELECT v, n, sum(st) OVER (ORDER BY v) AS bin FROM f), h AS (SELECT min(v) AS lo, max(v) AS hi, sum(n) AS n FROM g GROUP BY bin)
SELECT lo, hi, CAST(n AS BIGINT) AS n, round(CAST(n + 1 AS DOUBLE) / (sum(n) OVER () + count(*) OVER ()), 9) AS pdf FROM h"""
)
def hist_gap_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    domain = leaves.value_counts(li, ["l_quantity"]).select("col", "v")
    part = leaves.value_counts(li.where("l_quantity <= 10 or l_quantity between 20 and 25"), ["l_quantity"])
    return leaves.histogram(part, domain).select("lo", "hi", "n", F.round("pdf", 9).alias("pdf"))


@_add("SELECT CAST(nullif(l_linenumber, 3) AS DOUBLE) AS v, count(*) AS n FROM lineitem GROUP BY 1")
def null_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select(F.nullif(F.col("l_linenumber"), F.lit(3)).alias("x"))
    return leaves.value_counts(li, ["x"]).select("v", "n")


@_add(f"{_DUCK}, {_BINS} SELECT qid, w.col, round(coalesce(sum(pdf), 0), 9) AS p FROM w LEFT JOIN b ON w.col = b.col AND b.v <= w.hi AND b.v >= w.lo GROUP BY qid, w.col")
def range_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves.range_probability(_bins(spark, sf_dir), range_workload(spark)).select("qid", "col", F.round("p", 9).alias("p"))


@_add(f"WITH {_BINS}, q AS (SELECT CAST(range AS BIGINT) AS qid, CAST(range AS DOUBLE) AS v FROM range(60)) SELECT q.qid, 'l_quantity' AS col, round(coalesce(sum(pdf), 0), 9) AS p FROM q LEFT JOIN b ON b.col = 'l_quantity' AND b.v = q.v GROUP BY q.qid")
def point_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.range(60).select(F.col("id").alias("qid"), F.lit("l_quantity").alias("col"), F.col("id").cast("double").alias("v"))
    return leaves.point_probability(_bins(spark, sf_dir), points).select("qid", "col", F.round("p", 9).alias("p"))


@_add(
    f"""{_DUCK}, {_BINS}, p AS (SELECT qid, w.col, coalesce(sum(pdf), 0) AS p FROM w LEFT JOIN b ON w.col = b.col AND b.v <= w.hi AND b.v >= w.lo GROUP BY qid, w.col)
SELECT qid, round(product(p) * (SELECT count(*) FROM lineitem), 3) AS estimate FROM p GROUP BY qid"""
)
def independent_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "lineitem").count()
    p = leaves.product(leaves.range_probability(_bins(spark, sf_dir), range_workload(spark)))
    return p.select("qid", F.round(F.col("p") * n, 3).alias("estimate"))


_INSIDE = " AND ".join(f"bool_and(w.col <> '{c}' OR l.{c} BETWEEN w.lo AND w.hi)" for c in COLUMNS)
_CARD = "SELECT qid, (SELECT count(*) FROM lineitem l WHERE " + " AND ".join(f"(lo_{c} IS NULL OR l.{c} BETWEEN lo_{c} AND hi_{c})" for c in COLUMNS) + ") AS card FROM (SELECT qid, " + ", ".join(f"max(lo) FILTER (WHERE col = '{c}') AS lo_{c}, max(hi) FILTER (WHERE col = '{c}') AS hi_{c}" for c in COLUMNS) + " FROM w GROUP BY qid) q"


@_add(f"{_DUCK} {_CARD}")
def true_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.true_cardinality(_table(spark, sf_dir, "lineitem"), range_workload(spark))


@_add(
    f"""{_DUCK}, {_BINS}, t AS ({_CARD}), p AS (SELECT qid, w.col, coalesce(sum(pdf), 0) AS p FROM w LEFT JOIN b ON w.col = b.col AND b.v <= w.hi AND b.v >= w.lo GROUP BY qid, w.col),
e AS (SELECT qid, greatest(1.0, round_even(product(p) * (SELECT count(*) FROM lineitem), 0)) AS est FROM p GROUP BY qid),
x AS (SELECT greatest(est / card, card / est) AS q FROM e JOIN t USING (qid) WHERE card > 0)
SELECT round(quantile_cont(q, 0.5), 6) AS p50, round(quantile_cont(q, 0.9), 6) AS p90, round(quantile_cont(q, 0.95), 6) AS p95, round(quantile_cont(q, 0.99), 6) AS p99, round(max(q), 6) AS worst, round(avg(q), 6) AS mean FROM x"""
)
def qerr_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    n = li.count()
    est = leaves.product(leaves.range_probability(_bins(spark, sf_dir), range_workload(spark))).select("qid", F.greatest(F.lit(1.0), F.rint(F.col("p") * n)).alias("estimate"))
    out = ws.report(ws.q_errors(est.join(ws.true_cardinality(li, range_workload(spark)), "qid")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_MASK = "m AS (SELECT qid, CAST(bit_or(CASE col WHEN 'l_quantity' THEN 1 WHEN 'l_discount' THEN 2 WHEN 'l_tax' THEN 4 ELSE 8 END) AS BIGINT) AS mask FROM w GROUP BY qid)"


@_add(f"{_DUCK}, {_MASK} SELECT mask, count(*) AS n FROM m GROUP BY mask")
def mask_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.mask_groups(range_workload(spark), COLUMNS)


@_add(f"{_DUCK}, {_MASK}, g AS (SELECT mask, count(*) AS n FROM m GROUP BY mask) SELECT x.mask AS a, y.mask AS b, CAST(bit_count(x.mask & y.mask) * (x.n + y.n) AS BIGINT) AS w FROM g x JOIN g y ON x.mask < y.mask")
def maxcut_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.cut_edges(ws.mask_groups(range_workload(spark), COLUMNS))


@_add(f"{_DUCK}, k AS (SELECT qid, count(*) AS k FROM w GROUP BY qid) SELECT x.col AS i, y.col AS j, CAST(sum(CASE WHEN x.col <> y.col THEN 1 WHEN k = 1 THEN 3 ELSE 2 END) AS BIGINT) AS w FROM w x JOIN w y ON x.qid = y.qid JOIN k ON k.qid = x.qid GROUP BY 1, 2")
def coaccess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.coaccess(range_workload(spark))


@_add(
    f"""{_DUCK}, a AS (SELECT x.col AS i, y.col AS j, CAST(count(*) AS DOUBLE) / 60 AS share FROM w x JOIN w y ON x.qid = y.qid WHERE x.col < y.col GROUP BY 1, 2)
SELECT i, j, round(exp(-5 * share) * (0.2 / (1 - exp(-5))) + (0.3 - 0.2 / (1 - exp(-5))), 9) AS threshold FROM a"""
)
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = ws.coaccess(range_workload(spark)).where("i < j")
    return share.select("i", "j", F.round(ws.adaptive_threshold(F.col("w") / F.lit(60.0)), 9).alias("threshold"))


@_add(f"{_DUCK}, {_MASK}, e AS (SELECT * FROM (VALUES (0, 1), (0, 3), (1, 4), (1, 14), (2, 8)) t(pos, em)), s AS (SELECT qid, pos, max(bit_count(CAST(em AS BIGINT) & mask)) AS best, bit_count(bit_or(CAST(em AS BIGINT)) & mask) AS part FROM m, e GROUP BY qid, pos, mask) SELECT qid, pos FROM (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY best DESC, part DESC, pos) AS r FROM s) WHERE r = 1")
def route_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame([(0, 1), (0, 3), (1, 4), (1, 14), (2, 8)], "pos int, mask long")
    return ws.route(ws.masks(range_workload(spark), COLUMNS), edges)


@_add("WITH c AS (SELECT CAST(p_size AS DOUBLE) AS v, count(*) AS n FROM part GROUP BY 1) SELECT v, round(CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) / sum(n) OVER (), 9) AS ecdf FROM c")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves.ecdf(_table(spark, sf_dir, "part"), "p_size").select("v", F.round("ecdf", 9).alias("ecdf"))


@_add("SELECT CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE), 9) AS pdf FROM lineitem GROUP BY 1, 2")
def multi_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves.joint_histogram(_table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"]).withColumn("pdf", F.round("pdf", 9))


@_add(f"WITH {_BINS} SELECT col, round(sum(pdf * v), 6) AS m1, round(sum(pdf * v * v), 6) AS m2, round(sum(pdf * v * v) - sum(pdf * v) * sum(pdf * v), 6) AS variance FROM b GROUP BY col")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bins(spark, sf_dir)
    m1, m2 = leaves.moment(b, 1).withColumnRenamed("value", "m1"), leaves.moment(b, 2).withColumnRenamed("value", "m2")
    return m1.join(m2, "col").select("col", F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2"), F.round(F.expr("m2 - m1 * m1"), 6).alias("variance"))


@_add(f"WITH {_BINS} SELECT col, round(sum(CASE WHEN v > 2 AND v <= 30 THEN pdf / v ELSE 0 END), 9) AS value FROM b GROUP BY col")
def expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves.expectation(_bins(spark, sf_dir), 2, 30, low_in=False, power=-1).select("col", F.round("value", 9).alias("value"))


@_add(
    """SELECT round(avg(x), 6) AS gaussian_mean, round(stddev_pop(x), 6) AS gaussian_stdev, round(avg(x), 6) AS poisson_mean, round(avg(x), 6) AS exponential_mean, min(x) AS uniform_start, max(x) AS uniform_end, round(1 / (max(x) - min(x)), 9) AS uniform_density,
round(avg(ln(x)), 6) AS lognormal_mean, round(stddev_pop(ln(x)), 6) AS lognormal_stdev, round(count(x) / sum(x), 9) AS geometric_p, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS bernoulli_p,
round((3 - (ln(avg(x)) - avg(ln(x))) + sqrt(pow(ln(avg(x)) - avg(ln(x)) - 3, 2) + 24 * (ln(avg(x)) - avg(ln(x))))) / (12 * (ln(avg(x)) - avg(ln(x)))), 6) AS gamma_alpha,
round((3 - (ln(avg(x)) - avg(ln(x))) + sqrt(pow(ln(avg(x)) - avg(ln(x)) - 3, 2) + 24 * (ln(avg(x)) - avg(ln(x))))) / (12 * (ln(avg(x)) - avg(ln(x)))) / avg(x), 9) AS gamma_beta
FROM (SELECT CAST(l_quantity AS DOUBLE) AS x FROM lineitem)"""
)
def parametric_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaves.fit(_table(spark, sf_dir, "lineitem"), "l_quantity")
    digits = {"uniform_density": 9, "geometric_p": 9, "gamma_beta": 9}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if not c.startswith("uniform_") or c in digits else F.col(c) for c in out.columns])


@_add("SELECT 'l_quantity' AS col, v, sum(n)::BIGINT AS n FROM (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT CAST(l_quantity AS DOUBLE), -count(*) FROM lineitem WHERE l_linenumber = 2 GROUP BY 1 UNION ALL SELECT CAST(l_linenumber + 100 AS DOUBLE), count(*) FROM lineitem GROUP BY 1) GROUP BY v HAVING sum(n) > 0")
def hist_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    now = leaves.update(leaves.value_counts(li, ["l_quantity"]), leaves.value_counts(li.where("l_linenumber = 2"), ["l_quantity"]), -1)
    return leaves.update(now, leaves.value_counts(li.select((F.col("l_linenumber") + 100).alias("l_quantity")), ["l_quantity"]))


@_add("SELECT side, count(*) AS n, sum(l_quantity) AS total FROM (SELECT l_quantity, CASE WHEN l_extendedprice > (SELECT median(l_extendedprice) FROM lineitem) THEN 1 ELSE 0 END AS side FROM lineitem) GROUP BY side")
def median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dep.median_split(_table(spark, sf_dir, "lineitem"), "l_extendedprice").groupBy("side").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


_CENTRES = [[10.0, 0.02], [30.0, 0.05], [45.0, 0.08]]
_SIDES = "s AS (SELECT l_quantity, l_discount, list_position(d, list_min(d)) - 1 AS side FROM (SELECT l_quantity, l_discount, [" + ", ".join(f"(l_quantity - {a}) * (l_quantity - {a}) + (l_discount - {b}) * (l_discount - {b})" for a, b in _CENTRES) + "] AS d FROM lineitem)), x AS (SELECT side, 'l_quantity' AS col, l_quantity AS v FROM s UNION ALL SELECT side, 'l_discount', l_discount FROM s), bx AS (SELECT CAST(side AS INT) AS side, col, min(v) AS lo, max(v) AS hi, count(*) AS n FROM x GROUP BY 1, 2)"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dep.boxes(dep.centre_split(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], _CENTRES), ["l_quantity", "l_discount"])


@_add(f"WITH {_SIDES} SELECT * FROM bx")
def sum_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)


@_add(f"{_DUCK}, {_SIDES} SELECT qid, side, CASE WHEN bool_or(w.lo > bx.hi OR w.hi < bx.lo) THEN 0 WHEN bool_and(w.lo <= bx.lo AND w.hi >= bx.hi) THEN 1 ELSE -1 END AS verdict FROM w JOIN bx ON w.col = bx.col GROUP BY qid, side")
def sum_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dep.prune(_sides(spark, sf_dir), range_workload(spark))


_LINES = ["orders,lineitem#orders.o_orderkey=lineitem.l_orderkey#lineitem.l_quantity,<=,10,lineitem.l_quantity,>,2,orders.o_custkey,=,7#100", "customer,orders#customer.c_custkey=orders.o_custkey##50", "lineitem##lineitem.l_tax,<,3,lineitem.l_tax,>,5#7", "customer,orders,lineitem#orders.o_custkey=customer.c_custkey,orders.o_orderkey=lineitem.l_orderkey#customer.c_acctbal,>=,0#9"]


def _joins(spark: SparkSession) -> DataFrame:
    return workload.parse_joins(spark.createDataFrame([(i, x) for i, x in enumerate(_LINES)], "qid long, value string"))


@_add("SELECT * FROM (VALUES (0::BIGINT, 'lineitem', 'l_quantity', 3.0::DOUBLE, 10.0::DOUBLE, false), (0, 'orders', 'o_custkey', 7, 7, false), (2, 'lineitem', 'l_tax', 6, 2, true), (3, 'customer', 'c_acctbal', 0, 'infinity'::DOUBLE, false)) t(qid, tbl, col, lo, hi, empty)")
def normalise_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.normalise(_joins(spark))


@_add("SELECT * FROM (VALUES ('customer.c_custkey', 'orders.o_custkey', 2::BIGINT), ('lineitem.l_orderkey', 'orders.o_orderkey', 2)) t(a, b, n)")
def join_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.join_patterns(_joins(spark))


@_add("SELECT * FROM (VALUES ('customer', 'orders', 2::BIGINT), ('customer', 'lineitem', 1), ('lineitem', 'orders', 2)) t(a, b, n)")
def table_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.table_patterns(_joins(spark))


@_add("SELECT * FROM (VALUES ('customer.c_custkey', 0), ('lineitem.l_orderkey', 1), ('orders.o_custkey', 0), ('orders.o_orderkey', 1)) t(ref, id)")
def join_key_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(r.a, r.b) for r in ws.join_patterns(_joins(spark)).collect()]
    return spark.createDataFrame(sorted(ws.key_classes(pairs).items()), "ref string, id int")


@_add("SELECT floor(l_orderkey / 5000.0)::BIGINT AS bin_l_orderkey, floor(l_partkey / 500.0)::BIGINT AS bin_l_partkey, count(*) AS n, count(DISTINCT l_orderkey) AS ndv_l_orderkey, count(DISTINCT l_partkey) AS ndv_l_partkey, round(avg(CASE WHEN l_quantity <= 10 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS p FROM lineitem GROUP BY 1, 2")
def partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jm.partition_stats(_table(spark, sf_dir, "lineitem"), {"l_orderkey": (0, 5000), "l_partkey": (0, 500)}, F.col("l_quantity") <= 10).withColumn("p", F.round("p", 9))


@_add("WITH a AS (SELECT o_orderkey AS v, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT v, CAST(product(n) AS DOUBLE) AS size FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY v ORDER BY size DESC, v LIMIT 20")
def special_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jm.special_values([(_table(spark, sf_dir, "orders"), "o_orderkey"), (_table(spark, sf_dir, "lineitem"), "l_orderkey")], 20)


_FILTERED = """o AS (SELECT floor(o_orderkey / 5000.0) AS b, count(*)::DOUBLE AS n, count(DISTINCT o_orderkey)::DOUBLE AS d, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM orders GROUP BY 1),
l AS (SELECT floor(l_orderkey / 5000.0) AS b, count(*)::DOUBLE AS n, count(DISTINCT l_orderkey)::DOUBLE AS d, avg(CASE WHEN l_quantity <= 10 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM lineitem GROUP BY 1),
fo AS (SELECT b, n * p AS n, d * (1 - pow(1 - p, n / d)) AS d FROM o), fl AS (SELECT b, n * p AS n, d * (1 - pow(1 - p, n / d)) AS d FROM l)"""


@_add(f"WITH {_FILTERED} SELECT round(sum(fl.n * (fo.n / fo.d) * least(1.0, fo.d / fl.d)), 4) AS estimate FROM fl JOIN (SELECT b, sum(n) AS n, 5000.0::DOUBLE * (1 - product(1 - d / 5000.0::DOUBLE)) AS d FROM fo GROUP BY b) fo ON fl.b = fo.b")
def bin_join_est(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = (0, 5000)
    est = jm.estimate({"orders": (_table(spark, sf_dir, "orders"), {"o_orderkey": bins}, F.col("o_orderstatus") == "F"), "lineitem": (_table(spark, sf_dir, "lineitem"), {"l_orderkey": bins}, F.col("l_quantity") <= 10)}, [("orders", "o_orderkey", "lineitem", "l_orderkey")])
    return est.select(F.round("estimate", 4).alias("estimate"))


@_add("WITH c AS (SELECT floor(l_orderkey / 5000.0)::BIGINT AS bin_l_orderkey, floor(l_partkey / 500.0) AS q, count(*) AS n, count(DISTINCT l_orderkey)::DOUBLE AS d FROM lineitem GROUP BY 1, 2) SELECT bin_l_orderkey, sum(n)::DOUBLE AS n, round(5000 * (1 - product(1 - d / 5000)), 4) AS ndv_l_orderkey FROM c GROUP BY 1")
def merge_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = jm.filtered(jm.partition_stats(_table(spark, sf_dir, "lineitem"), {"l_orderkey": (0, 5000), "l_partkey": (0, 500)}), ["l_orderkey", "l_partkey"])
    return jm.merge(parts, "l_orderkey", 5000).withColumn("ndv_l_orderkey", F.round("ndv_l_orderkey", 4))


@_add("WITH a AS (SELECT o_custkey AS k, count(*) AS n_a FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS n_b FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), j AS (SELECT k, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (k)) SELECT k, n_a, n_b, greatest(n_a, 1) * greatest(n_b, 1) AS rows, CASE WHEN n_a > 0 THEN 1.0::DOUBLE / greatest(n_b, 1) ELSE 0.0 END AS scatter_a, CASE WHEN n_b > 0 THEN 1.0::DOUBLE / greatest(n_a, 1) ELSE 0.0 END AS scatter_b FROM j")
def outer_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jm.outer_scatter(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey")


_BUCKETS = "SELECT bucket, sum(n)::BIGINT AS n, arg_min(v, (-n, v)) AS mcv, max(n) AS mcv_n, count(*) AS ndv FROM (SELECT floor({k} / 15001.0 * 20)::BIGINT AS bucket, {k} AS v, count(*) AS n FROM {t} GROUP BY 1, 2) GROUP BY bucket"


def _buckets(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return jm.bucket_stats(_table(spark, sf_dir, table), key, 20, 0, 15000)


@_add(_BUCKETS.format(k="l_orderkey", t="lineitem"))
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir, "lineitem", "l_orderkey")


@_add(f"WITH a AS ({_BUCKETS.format(k='l_orderkey', t='lineitem')}), b AS ({_BUCKETS.format(k='o_orderkey', t='orders')}) SELECT bucket, a.mcv_n * b.mcv_n * least(a.n / a.mcv_n::DOUBLE, b.n / b.mcv_n::DOUBLE) AS bound FROM a JOIN b USING (bucket)")
def bucket_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jm.bucket_bound(_buckets(spark, sf_dir, "lineitem", "l_orderkey"), _buckets(spark, sf_dir, "orders", "o_orderkey"))


@_add("SELECT count(*) AS n, sum(coalesce(try_cast(s_name AS DOUBLE), 0)) AS numbers, sum(s_acctbal) AS total FROM supplier WHERE s_nationkey IS NOT NULL")
def numeric_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.numeric_table(_table(spark, sf_dir, "supplier"), ["s_name", "s_acctbal"], ["s_nationkey"])
    return t.agg(F.count("*").alias("n"), F.sum(F.coalesce("s_name", F.lit(0.0))).alias("numbers"), F.sum("s_acctbal").alias("total"))


def _boxes(spark: SparkSession) -> np.ndarray:
    out = np.tile(np.array([-np.inf, np.inf]), (60, len(COLUMNS), 1))
    for r in range_workload(spark).collect():
        out[r.qid, COLUMNS.index(r.col)] = r.lo, r.hi
    return out


@_add()
def rdc_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dep.rdc_by_slice(_table(spark, sf_dir, "lineitem").withColumn("side", F.col("l_linenumber") % 2), ["l_quantity", "l_extendedprice", "l_tax"], "side")


@_add()
def tree_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: learn a tree from lineitem and the workload, estimate the workload, compare with the truth."""
    li = _table(spark, sf_dir, "lineitem").withColumn("price", F.floor(F.col("l_extendedprice") / 1000))
    model = Model.fit(li, [*COLUMNS, "price"], np.concatenate([_boxes(spark), np.tile(np.array([-np.inf, np.inf]), (60, 1, 1))], axis=1))
    w = range_workload(spark)
    return model.estimate(w).join(ws.true_cardinality(li, w), "qid")


@_add()
def model_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Model.fit(_table(spark, sf_dir, "lineitem"), COLUMNS, _boxes(spark))
    return spark.createDataFrame(sorted(model.statistics().items()), "what string, n int")


@_add(
    f"""{_DUCK}, {_MASK}, g AS (SELECT mask, n, row_number() OVER (ORDER BY mask) - 1 AS i FROM (SELECT mask, count(*) AS n FROM m GROUP BY mask) t),
e AS (SELECT x.i AS a, y.i AS b, bit_count(x.mask & y.mask) * (x.n + y.n) AS w FROM g x JOIN g y ON x.i < y.i),
c AS (SELECT bits, sum(CASE WHEN (bits >> a) & 1 <> (bits >> b) & 1 THEN w ELSE 0 END) / CAST(sum(w) AS DOUBLE) AS cut FROM (SELECT CAST(range AS BIGINT) AS bits FROM range(64)) k, e GROUP BY bits)
SELECT 0 AS side, mask, (SELECT round(max(cut), 9) FROM c) AS cut FROM g WHERE (SELECT max(cut) FROM c) < 0.7"""
)
def query_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy cut; SQL tries every cut. The best parts under 0.7 of the weight, so the queries stay together."""
    groups = [(r["mask"], r["n"]) for r in ws.mask_groups(range_workload(spark), COLUMNS).collect()]
    sides, cut = ws.split_queries(groups)
    return spark.createDataFrame([(i, m, round(cut, 9)) for i, s in enumerate(sides) for m in s], "side int, mask long, cut double")


@_add()
def toy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.toy(spark, "highly_correlated_cat", 1000)

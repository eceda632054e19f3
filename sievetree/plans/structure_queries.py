"""Registered queries of the further leaves, join variants, Chow-Liu trees and factorize nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import densities, leaves, parametric
from ..operators import splits
from ..operators import workload_stats as ws
from . import chow_liu, factorize, join_variants, transforms
from . import join_model as jm
from .queries import _BINS, _BUCKETS, _DUCK, COLUMNS, _add, _bins, _buckets, _table, range_workload
from .tree import Model, Node

_PIECES = f"""{_BINS}, s AS (SELECT col, v AS x0, pdf AS y0, lead(v) OVER (PARTITION BY col ORDER BY v) AS x1, lead(pdf) OVER (PARTITION BY col ORDER BY v) AS y1 FROM b),
ar AS (SELECT col, sum((x1 - x0) * (y0 + y1) / 2) AS area FROM s WHERE x1 IS NOT NULL GROUP BY col), pc AS (SELECT s.col, x0, x1, y0 / area AS y0, y1 / area AS y1 FROM s JOIN ar ON s.col = ar.col WHERE x1 IS NOT NULL)"""


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@_add(
    f"""{_DUCK}, {_PIECES}, j AS (SELECT qid, w.col, greatest(lo, x0) AS a, least(hi, x1) AS z, x0, x1, y0, y1 FROM w LEFT JOIN pc ON w.col = pc.col AND x0 <= hi AND x1 >= lo)
SELECT qid, col, round(coalesce(sum((z - a) * (2 * y0 + (y1 - y0) * (a + z - 2 * x0) / (x1 - x0)) / 2), 0), 8) AS p FROM j GROUP BY qid, col"""
)
def piecewise_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(densities.piecewise_probability(densities.piecewise(_bins(spark, sf_dir)), range_workload(spark)), 8, "p")


@_add(f"WITH {_PIECES}, q AS (SELECT CAST(range AS BIGINT) AS qid, CAST(range AS DOUBLE) + CAST(0.25 AS DOUBLE) AS v FROM range(60)) SELECT qid, 'l_quantity' AS col, round(coalesce(y0 + (y1 - y0) * (v - x0) / (x1 - x0), 0), 9) AS density, round(coalesce((y1 - y0) / (x1 - x0), 0), 9) AS slope FROM q LEFT JOIN pc ON pc.col = 'l_quantity' AND v >= x0 AND v < x1")
def piecewise_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.range(60).select(F.col("id").alias("qid"), F.lit("l_quantity").alias("col"), (F.col("id") + F.lit(0.25)).alias("v"))
    return _rounded(densities.piecewise_density(densities.piecewise(_bins(spark, sf_dir)), points), 9, "density", "slope")


@_add(f"WITH {_PIECES} SELECT col, round(sum((y0 - (y1 - y0) / (x1 - x0) * x0) * (x1 * x1 - x0 * x0) / 2 + (y1 - y0) / (x1 - x0) * (x1 * x1 * x1 - x0 * x0 * x0) / 3), 7) AS value FROM pc GROUP BY col")
def piecewise_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(densities.piecewise_moment(densities.piecewise(_bins(spark, sf_dir))), 7, "value")


@_add(f"WITH {_BINS} SELECT col, arg_min(v, (-n, v)) AS mode FROM b GROUP BY col")
def leaf_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densities.mode(_bins(spark, sf_dir))


@_add(f"WITH {_BINS} SELECT col, arg_min(v, (-n, v)) AS mode FROM b GROUP BY col")
def piecewise_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densities.piecewise_mode(densities.piecewise(_bins(spark, sf_dir)))


@_add(f"WITH {_BINS} SELECT col, v AS lo, round((coalesce(lead(pdf) OVER o, 0) - coalesce(lag(pdf) OVER o, 0)) / 2, 9) AS slope FROM b WINDOW o AS (PARTITION BY col ORDER BY v)")
def leaf_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(densities.slopes(_bins(spark, sf_dir)), 9, "slope")


@_add("WITH c AS (SELECT CAST(floor(l_linenumber / 3.0) AS BIGINT) AS given, CAST(l_tax AS DOUBLE) AS lo, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT given, 'l_tax' AS col, lo, n, round(CAST(n + 1 AS DOUBLE) / (sum(n) OVER (PARTITION BY given) + count(*) OVER (PARTITION BY given)), 9) AS pdf FROM c")
def conditional_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = densities.conditional_histogram(_table(spark, sf_dir, "lineitem"), "l_tax", F.floor(F.col("l_linenumber") / 3))
    return out.select("given", "col", "lo", "n", F.round("pdf", 9).alias("pdf"))


@_add("SELECT p_brand AS v, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE), 9) AS p FROM part GROUP BY 1")
def categorical_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(densities.categorical(_table(spark, sf_dir, "part"), "p_brand"), 9, "p")


@_add("WITH q AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), ['BUILDING', 'MACHINERY', 'BUILDING']), (CAST(1 AS BIGINT), ['nothing']), (CAST(2 AS BIGINT), ['FURNITURE'])) t(qid, vs)) SELECT qid, round((SELECT count(*) FROM customer WHERE list_contains(vs, c_mktsegment)) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 9) AS p FROM q")
def categorical_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = spark.createDataFrame([(0, ["BUILDING", "MACHINERY", "BUILDING"]), (1, ["nothing"]), (2, ["FURNITURE"])], "qid long, values array<string>")
    return _rounded(densities.in_list(densities.categorical(_table(spark, sf_dir, "customer"), "c_mktsegment"), lists), 9, "p")


_GAUSS = ["l_quantity", "l_extendedprice", "l_tax"]


@_add(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(avg(CAST({a} AS DOUBLE)), 5) AS mean_i, round(avg(CAST({b} AS DOUBLE)), 5) AS mean_j, round(covar_samp(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 2) AS covariance FROM lineitem" for k, a in enumerate(_GAUSS) for b in _GAUSS[k:]))
def gaussian_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(densities.gaussian(_table(spark, sf_dir, "lineitem"), _GAUSS), 5, "mean_i", "mean_j"), 2, "covariance")


@_add("SELECT l_returnflag, round(sum(l_tax * x) / sum(l_tax), 7) AS mean, round(sqrt(sum(l_tax * x * x) / sum(l_tax) - pow(sum(l_tax * x) / sum(l_tax), 2)), 7) AS stdev, round(sum(CASE WHEN x > 0 THEN l_tax ELSE 0 END) / sum(l_tax), 7) AS share_positive FROM (SELECT l_returnflag, l_tax, CAST(l_discount AS DOUBLE) AS x FROM lineitem) GROUP BY 1")
def weighted_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(densities.weighted_fit(_table(spark, sf_dir, "lineitem"), "l_discount", F.col("l_tax"), ["l_returnflag"]), 7, "mean", "stdev", "share_positive")


def mixture_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = densities.mixture(_table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return spark.createDataFrame([(i, p["weight"], p["mean"], p["stdev"]) for i, p in enumerate(found)], "part int, weight double, mean double, stdev double")


_add()(mixture_leaf)

_CELLS = """c AS (SELECT floor(l_orderkey / 5000.0) AS x, floor(l_partkey / 500.0) AS y, count(*)::DOUBLE AS n, count(DISTINCT l_orderkey)::DOUBLE AS dx, count(DISTINCT l_partkey)::DOUBLE AS dy, avg(CASE WHEN l_quantity <= 10 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM lineitem GROUP BY 1, 2),
o AS (SELECT floor(o_orderkey / 5000.0) AS x, count(*)::DOUBLE AS no, count(DISTINCT o_orderkey)::DOUBLE AS d_o FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT floor(p_partkey / 500.0) AS y, count(*)::DOUBLE AS np, count(DISTINCT p_partkey)::DOUBLE AS dp FROM part WHERE p_size <= 25 GROUP BY 1),
j AS (SELECT *, d_o / 5000 AS ro, dp / 500 AS rp, least(1.0, d_o / dx) AS lo, least(1.0, dp / dy) AS lp, n * p.np * o.no * c.p AS rows, n * c.p * (no / d_o) * (np / dp) AS fan FROM c JOIN o ON c.x = o.x JOIN p ON c.y = p.y)"""


@_add(
    f"""WITH {_CELLS}, v AS (SELECT 'independent' AS variant, sum(rows / 5000 / 500) AS estimate FROM j
 UNION ALL SELECT 'easy', sum(rows / 5000 / sqrt(500.0)) FROM j
 UNION ALL SELECT 'double_easy', sum(rows / sqrt(5000.0) / sqrt(sqrt(500.0))) FROM j
 UNION ALL SELECT 'ndv', sum(fan * least(ro, rp) * sqrt(greatest(ro, rp))) FROM j
 UNION ALL SELECT 'double_ndv', sum(fan * least(kx, ky) * sqrt(greatest(kx, ky))) FROM (SELECT fan, least(dx / 5000, ro) * sqrt(greatest(dx / 5000, ro)) AS kx, least(dy / 500, rp) * sqrt(greatest(dy / 500, rp)) AS ky FROM j)
 UNION ALL SELECT 'least_ndv', sum(fan * least(lo, lp) * sqrt(greatest(lo, lp))) FROM j
 UNION ALL SELECT 'one_least_ndv', sum(fan * least(lo, lp)) FROM j) SELECT variant, round(estimate, 3) AS estimate FROM v"""
)
def join_scalings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = jm.partition_stats(_table(spark, sf_dir, "lineitem"), {"l_orderkey": (0, 5000), "l_partkey": (0, 500)}, F.col("l_quantity") <= 10)
    o = jm.partition_stats(_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), {"o_orderkey": (0, 5000)}).select(F.col("bin_o_orderkey").alias("bin_l_orderkey"), F.col("n").alias("o_n"), F.col("ndv_o_orderkey").alias("o_ndv"))
    p = jm.partition_stats(_table(spark, sf_dir, "part").where("p_size <= 25"), {"p_partkey": (0, 500)}).select(F.col("bin_p_partkey").alias("bin_l_partkey"), F.col("n").alias("p_n"), F.col("ndv_p_partkey").alias("p_ndv"))
    keys = [join_variants.Key(5000, F.col("ndv_l_orderkey"), [(F.col("o_n"), F.col("o_ndv"))]), join_variants.Key(500, F.col("ndv_l_partkey"), [(F.col("p_n"), F.col("p_ndv"))])]
    joined = cells.join(o, "bin_l_orderkey").join(p, "bin_l_partkey")
    one = joined.agg(*[F.sum(join_variants.scaled(F.col("n"), F.col("p"), keys, how)).alias(how) for how in join_variants.VARIANTS])
    return one.unpivot([], list(join_variants.VARIANTS), "variant", "estimate").select("variant", F.round("estimate", 3).alias("estimate"))


@_add("WITH c AS (SELECT floor(l_orderkey / 5000.0)::BIGINT AS bin_l_orderkey, floor(l_partkey / 500.0) AS q, count(*) AS n, count(DISTINCT l_orderkey) AS d FROM lineitem GROUP BY 1, 2) SELECT bin_l_orderkey, sum(n)::BIGINT AS n, max(d) AS ndv_l_orderkey FROM c GROUP BY 1")
def merge_most_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_variants.merge_most(jm.partition_stats(_table(spark, sf_dir, "lineitem"), {"l_orderkey": (0, 5000), "l_partkey": (0, 500)}), "l_orderkey")


def sampled_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_variants.sampled(_table(spark, sf_dir, "lineitem"), F.col("l_quantity") <= 10)


_add()(sampled_estimate)

_FEW = ["l_discount", "l_tax", "l_linenumber"]


@_add(
    " UNION ALL ".join(
        f"""SELECT '{a}' AS i, '{b}' AS j, round(sum(n / t * ln(n * t / (na * nb))), 9) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2))"""
        for k, a in enumerate(_FEW)
        for b in _FEW[k + 1 :]
    )
)
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(chow_liu.mutual_information(chow_liu.pair_counts(_table(spark, sf_dir, "lineitem"), _FEW)), 9, "mi")


def chow_liu_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = chow_liu.ChowLiu.fit(_table(spark, sf_dir, "lineitem"), _FEW)
    rows = [(c, tree.parent[c], float(np.log(s[s > 0]).sum())) for c, s in tree.shares.items()]
    return spark.createDataFrame(rows, "col string, parent string, log_shares double")


_add()(chow_liu_leaf)


@_add("SELECT v AS cut FROM (SELECT CAST(l_quantity AS DOUBLE) AS v, sum(count(*)) OVER (ORDER BY CAST(l_quantity AS DOUBLE)) / CAST(sum(count(*)) OVER () AS DOUBLE) AS e FROM lineitem GROUP BY 1), (SELECT CAST(range AS DOUBLE) / 5 AS s FROM range(1, 5)) WHERE e >= s GROUP BY s, v QUALIFY row_number() OVER (PARTITION BY s ORDER BY v) = 1")
def equal_mass_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in factorize.equal_mass(_table(spark, sf_dir, "lineitem"), "l_quantity", 5)], "cut double")


_WIDE = ", ".join(f"max(lo) FILTER (WHERE col = '{c}') AS lo_{c}, max(hi) FILTER (WHERE col = '{c}') AS hi_{c}" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber"))


@_add(
    f"""{_DUCK}, z AS (SELECT qid, {_WIDE} FROM w GROUP BY qid), r0 AS (SELECT CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS box, * FROM lineitem),
lb AS (SELECT qid, box, CAST(count(*) AS DOUBLE) AS n FROM z JOIN r0 ON (lo_l_linenumber IS NULL OR l_linenumber BETWEEN lo_l_linenumber AND hi_l_linenumber) AND (lo_l_tax IS NULL OR l_tax BETWEEN lo_l_tax AND hi_l_tax) GROUP BY 1, 2),
rl AS (SELECT box, 'l_quantity' AS col, CAST(l_quantity AS DOUBLE) AS v FROM r0 UNION ALL SELECT box, 'l_discount', CAST(l_discount AS DOUBLE) FROM r0), rc AS (SELECT box, col, v, count(*) AS n FROM rl GROUP BY 1, 2, 3),
rb AS (SELECT box, col, v, CAST(n + 1 AS DOUBLE) / (sum(n) OVER (PARTITION BY box, col) + count(*) OVER (PARTITION BY box, col)) AS pdf FROM rc),
pq AS (SELECT qid, box, coalesce((SELECT sum(pdf) FROM rb WHERE rb.box = lb.box AND rb.col = 'l_quantity' AND v BETWEEN lo_l_quantity AND hi_l_quantity), CASE WHEN lo_l_quantity IS NULL THEN 1 ELSE 0 END) AS a, coalesce((SELECT sum(pdf) FROM rb WHERE rb.box = lb.box AND rb.col = 'l_discount' AND v BETWEEN lo_l_discount AND hi_l_discount), CASE WHEN lo_l_discount IS NULL THEN 1 ELSE 0 END) AS b, n FROM lb JOIN z USING (qid))
SELECT z.qid, round(coalesce(sum(n * a * b), 0), 3) AS estimate FROM z LEFT JOIN pq ON z.qid = pq.qid GROUP BY z.qid"""
)
def factorized_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = factorize.Factorized.fit(_table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_tax"], ["l_quantity", "l_discount"], {"l_linenumber": [3.0]})
    return _rounded(node.estimate(range_workload(spark)), 3, "estimate")


_SPECIAL = """sp AS (SELECT v, row_number() OVER (ORDER BY size DESC, v) AS r FROM (SELECT v, CAST(product(n) AS DOUBLE) AS size FROM (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, count(*) FROM customer GROUP BY 1) GROUP BY v ORDER BY size DESC, v LIMIT 30)),
o AS (SELECT coalesce(-r, floor(o_custkey / 100.0)) AS b, count(*)::DOUBLE AS n, count(DISTINCT o_custkey)::DOUBLE AS d, avg(CASE WHEN o_totalprice > 200000 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM orders LEFT JOIN sp ON o_custkey = v GROUP BY 1),
c AS (SELECT coalesce(-r, floor(c_custkey / 100.0)) AS b, count(*)::DOUBLE AS n, count(DISTINCT c_custkey)::DOUBLE AS d, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM customer LEFT JOIN sp ON c_custkey = v GROUP BY 1),
fo AS (SELECT b, n * p AS n, d * (1 - pow(1 - p, n / d)) AS d FROM o), fc AS (SELECT b, n * p AS n, d * (1 - pow(1 - p, n / d)) AS d FROM c WHERE p > 0)"""


@_add(f"WITH {_SPECIAL} SELECT round(sum(fo.n * fc.n / fc.d * CASE WHEN fo.d > 0 THEN least(1.0, fc.d / fo.d) ELSE 1.0 END), 3) AS estimate FROM fo JOIN fc ON fo.b = fc.b")
def special_join_est(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    top = jm.ranked(jm.special_values([(orders, "o_custkey"), (customer, "c_custkey")], 30))
    tables = {"customer": (customer, {"c_custkey": (0, 100)}, F.col("c_mktsegment") == "BUILDING"), "orders": (orders, {"o_custkey": (0, 100)}, F.col("o_totalprice") > 200000)}
    est = jm.estimate(tables, [("customer", "c_custkey", "orders", "o_custkey")], special={"o_custkey": top, "c_custkey": top})
    return est.select(F.round("estimate", 3).alias("estimate"))


@_add(f"WITH a AS ({_BUCKETS.format(k='l_orderkey', t='lineitem')}), b AS ({_BUCKETS.format(k='o_orderkey', t='orders')}), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM b) SELECT bucket, round(sqrt(product(CAST(mcv_n AS DOUBLE)) * min(CAST(n AS DOUBLE) / mcv_n) * product(CAST(n AS DOUBLE) / ndv) * min(ndv)), 4) AS estimate FROM u GROUP BY bucket HAVING count(*) = 3")
def eliminated_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _buckets(spark, sf_dir, "orders", "o_orderkey")
    return _rounded(jm.eliminate([_buckets(spark, sf_dir, "lineitem", "l_orderkey"), o, o], 0.5), 4, "estimate")


@_add(f"WITH a AS ({_BUCKETS.format(k='l_orderkey', t='lineitem')}) SELECT bucket, n * CAST(0.25 AS DOUBLE) AS n, mcv_n * CAST(0.25 AS DOUBLE) AS mcv_n, least(CAST(ndv AS DOUBLE), n * CAST(0.25 AS DOUBLE)) AS ndv FROM a WHERE bucket BETWEEN 0 AND 9")
def scaled_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = jm.bucket_filter(_buckets(spark, sf_dir, "lineitem", "l_orderkey"), 0, 9)
    return jm.bucket_scale(stats, F.lit(0.25)).select("bucket", "n", "mcv_n", "ndv")


def _independent(spark: SparkSession, sf_dir: str) -> Model:
    root = Node("product", list(range(len(COLUMNS))), [Node("leaf", [i]) for i in range(len(COLUMNS))], "data")
    for i, node in enumerate(root.walk()):
        node.number = i
    return Model.fit(_table(spark, sf_dir, "lineitem"), COLUMNS, np.zeros((0, len(COLUMNS), 2)), root=root)


@_add(f"WITH {_BINS} SELECT l_linenumber, count(*) AS n, round(avg(ln(q.pdf) + ln(d.pdf) + ln(t.pdf) + ln(m.pdf)), 8) AS log_likelihood FROM lineitem JOIN b q ON q.col = 'l_quantity' AND q.v = l_quantity JOIN b d ON d.col = 'l_discount' AND d.v = l_discount JOIN b t ON t.col = 'l_tax' AND t.v = l_tax JOIN b m ON m.col = 'l_linenumber' AND m.v = l_linenumber GROUP BY 1")
def row_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transforms.likelihood(_independent(spark, sf_dir), _table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in COLUMNS]))
    return rows.groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber")).agg(F.count("*").alias("n"), F.round(F.avg("log_likelihood"), 8).alias("log_likelihood"))


@_add(f"WITH {_BINS} SELECT CAST(k AS INT) AS k, round(sum(pdf * pow(v, k)) / sum(pdf), 5) AS value FROM b, range(1, 4) t(k) WHERE col = 'l_quantity' AND v BETWEEN 10 AND 30 GROUP BY k")
def conditional_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = np.full(len(COLUMNS), -np.inf), np.full(len(COLUMNS), np.inf)
    lo[0], hi[0] = 10, 30
    model = _independent(spark, sf_dir)
    return spark.createDataFrame([(k, round(transforms.moment(model, "l_quantity", k, lo, hi), 5)) for k in (1, 2, 3)], "k int, value double")


def query_split_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = sorted((r.mask, r.n) for r in ws.mask_groups(range_workload(spark), COLUMNS).collect())
    sides, quality = splits.split_queries_by_means(groups, len(COLUMNS))
    return spark.createDataFrame([(i, m, quality) for i, s in enumerate(sides) for m in s], "side int, mask long, silhouette double")


_add()(query_split_means)


_FIT = """f AS (SELECT avg(x) AS m, stddev_pop(x) AS s, min(x) AS a, max(x) AS z, avg(ln(x)) AS lm, stddev_pop(ln(x)) AS ls, count(x) / sum(x) AS g, avg(CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS bp FROM (SELECT CAST(l_quantity AS DOUBLE) AS x FROM lineitem)),
h AS (SELECT *, (3 - (ln(m) - lm) + sqrt(pow(ln(m) - lm - 3, 2) + 24 * (ln(m) - lm))) / (12 * (ln(m) - lm)) AS al FROM f)"""


@_add(
    f"""WITH {_FIT}, q AS (SELECT CAST(range AS BIGINT) AS qid, CAST(range AS DOUBLE) AS x FROM range(60))
SELECT qid, round(exp(-pow((x - m) / s, 2) / 2) / (s * sqrt(2 * pi())), 9) AS gaussian, round(exp(-x / m) / m, 9) AS exponential, round(CASE WHEN x BETWEEN a AND z THEN 1 / (z - a) ELSE 0 END, 9) AS uniform,
round(CASE WHEN x > 0 THEN exp(-pow((ln(greatest(x, 1e-9)) - lm) / ls, 2) / 2) / (greatest(x, 1e-9) * ls * sqrt(2 * pi())) ELSE 0 END, 9) AS lognormal, round(exp(x * ln(m) - m - lgamma(x + 1)), 9) AS poisson, round(CASE WHEN x >= 1 THEN pow(1 - g, x - 1) * g ELSE 0 END, 9) AS geometric,
round(CASE WHEN x = 1 THEN bp WHEN x = 0 THEN 1 - bp ELSE 0 END, 9) AS bernoulli, round(CASE WHEN x > 0 THEN exp(al * ln(al / m) + (al - 1) * ln(greatest(x, 1e-9)) - al / m * x - lgamma(al)) ELSE 0 END, 9) AS gamma FROM q, h"""
)
def parametric_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.range(60).select(F.col("id").alias("qid"), F.col("id").cast("double").alias("x"), F.lit(1).alias("one"))
    fitted = leaves.fit(_table(spark, sf_dir, "lineitem"), "l_quantity").withColumn("one", F.lit(1))  # one row
    rows = points.join(F.broadcast(fitted), "one")
    return rows.select("qid", *[F.round(parametric.density(f, F.col("x")), 9).alias(f) for f in parametric.FAMILIES])


@_add(f"WITH {_FIT} SELECT round(m, 7) AS gaussian, 0.0::DOUBLE AS exponential, a AS uniform, round(exp(lm - ls * ls), 7) AS lognormal, CAST(ceil(m) - 1 AS DOUBLE) AS poisson, 1.0::DOUBLE AS geometric, CASE WHEN bp > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS bernoulli, round((al - 1) / (al / m), 7) AS gamma FROM h")
def parametric_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = leaves.fit(_table(spark, sf_dir, "lineitem"), "l_quantity")
    return fitted.select(*[F.round(parametric.mode(f), 7).alias(f) for f in parametric.FAMILIES])

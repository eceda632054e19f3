"""Registered queries of trained join models and of a tree of a fixed structure, with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .join_train import JoinModel, Query, Setting, query_text
from .queries import _DUCK, COLUMNS, _add, _table, range_workload
from .tree import Model, Node

WIDTH = 500.0
JOINS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey")]
FILTERS = {"lineitem": ["l_quantity", "l_discount"], "orders": ["o_status"], "customer": ["c_nationkey"]}
#: Three joins: two tables; three with two children at the root; three in a chain.
JOIN_QUERIES = [
    Query(["lineitem", "orders"], JOINS[:1], {"lineitem": {"l_quantity": (3.0, 10.0)}, "orders": {"o_status": (0.0, 0.0)}}),
    Query(["lineitem", "customer", "orders"], JOINS, {"lineitem": {"l_discount": (0.015, 0.055)}, "customer": {"c_nationkey": (0.0, 9.0)}, "orders": {"o_status": (1.0, 2.0)}}),
    Query(["lineitem", "orders", "customer"], JOINS, {"lineitem": {"l_quantity": (20.0, 50.0), "l_discount": (0.0, 0.035)}, "customer": {"c_nationkey": (5.0, 24.0)}}),
]


def _join_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return {
        "lineitem": _table(spark, sf_dir, "lineitem").select("l_orderkey", *FILTERS["lineitem"]),
        "orders": _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", status.alias("o_status")),
        "customer": _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
    }


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, query_text(q)) for i, q in enumerate(JOIN_QUERIES)], "qid long, query string")


_KEYS = {"lineitem": ["l_orderkey"], "orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey"]}
_LOW = {"l_orderkey": "lo_o", "o_orderkey": "lo_o", "o_custkey": "lo_c", "c_custkey": "lo_c"}


def _cell_sql() -> str:
    """Cells (b..., n, d...) of each table, and its leaves: bins of a value, or of a run of values that the cell lacks, smoothed by one."""
    parts = [
        "dom AS (SELECT least((SELECT min(l_orderkey) FROM lineitem), (SELECT min(o_orderkey) FROM orders)) AS lo_o, least((SELECT min(o_custkey) FROM orders), (SELECT min(c_custkey) FROM customer)) AS lo_c, greatest((SELECT max(o_custkey) FROM orders), (SELECT max(c_custkey) FROM customer)) AS hi_c)",
        "src_orders AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS o_status FROM orders)",
    ]
    for t, keys in _KEYS.items():
        source = "src_orders" if t == "orders" else t
        bins = ", ".join(f"floor(({k} - {_LOW[k]}) / {WIDTH})::BIGINT AS b_{k}" for k in keys)
        names = ", ".join(f"b_{k}" for k in keys)
        parts.append(f"row_{t} AS (SELECT {bins}, {', '.join([*keys, *FILTERS[t]])} FROM {source}, dom)")
        parts.append(f"cell_{t} AS (SELECT {names}, count(*)::DOUBLE AS n, {', '.join(f'count(DISTINCT {k})::DOUBLE AS d_{k}' for k in keys)} FROM row_{t} GROUP BY ALL)")
        for c in FILTERS[t]:
            cells = f"(SELECT DISTINCT {names} FROM row_{t})"
            same = " AND ".join(f"x.b_{k} = y.b_{k}" for k in keys)
            parts.append(f"v_{c} AS (SELECT {', '.join(f'x.b_{k}' for k in keys)}, x.v, coalesce(y.n, 0) AS n FROM (SELECT * FROM {cells}, (SELECT DISTINCT {c}::DOUBLE AS v FROM row_{t})) x LEFT JOIN (SELECT {names}, {c}::DOUBLE AS v, count(*) AS n FROM row_{t} GROUP BY ALL) y ON {same} AND x.v = y.v)")
            over = f"OVER (PARTITION BY {names} ORDER BY v)"
            parts.append(f"st_{c} AS (SELECT *, CASE WHEN n > 0 OR coalesce(lag(n) {over}, 1) > 0 THEN 1 ELSE 0 END AS st FROM v_{c})")
            parts.append(f"run_{c} AS (SELECT *, sum(st) {over} AS run FROM st_{c})")
            parts.append(f"bin_{c} AS (SELECT {names}, min(v) AS lo, max(v) AS hi, sum(n) AS n FROM run_{c} GROUP BY {names}, run)")
            parts.append(f"pdf_{c} AS (SELECT {names}, lo, hi, (n + 1)::DOUBLE / (sum(n) OVER (PARTITION BY {names}) + count(*) OVER (PARTITION BY {names})) AS pdf FROM bin_{c})")
    return ", ".join(parts)


def _kept(query: Query, name: str) -> str:
    """Each table of a query after its filter: rows n*p, keys d*(1-(1-p)^(n/d))."""
    parts = []
    for t in query.tables:
        keys = _KEYS[t]
        names = ", ".join(f"b_{k}" for k in keys)
        source, p = f"cell_{t}", "1.0::DOUBLE"
        for c, (lo, hi) in query.boxes.get(t, {}).items():
            source += f" JOIN (SELECT {names}, sum(pdf) AS p_{c} FROM pdf_{c} WHERE lo <= {hi} AND hi >= {lo} GROUP BY {names}) USING ({names})"
            p += f" * least(1.0, p_{c})"
        parts.append(f"f_{name}_{t} AS (SELECT {names}, n * p AS n, {', '.join(f'd_{k} * (1 - pow(1 - p, n / d_{k})) AS d_{k}' for k in keys)} FROM (SELECT *, {p} AS p FROM {source}) u)")
    return ", ".join(parts)


_LAST = f"w AS (SELECT o.*, least({WIDTH}, hi_c - lo_c + 1 - b_o_custkey * {WIDTH}) AS w FROM (SELECT o.b_o_custkey, o.n * (l.n / l.d_l_orderkey) * least(1.0, l.d_l_orderkey / o.d_o_orderkey) AS n, o.d_o_custkey AS d FROM f_c_orders o JOIN f_c_lineitem l ON o.b_o_orderkey = l.b_l_orderkey) o, dom), m AS (SELECT b_o_custkey, sum(n) AS n, w * (1 - product(greatest(0.0, 1 - d / w))) AS d FROM w GROUP BY b_o_custkey, w)"


@_add(
    f"""WITH {_cell_sql()}, {_kept(JOIN_QUERIES[0], "a")}, {_kept(JOIN_QUERIES[1], "b")}, {_kept(JOIN_QUERIES[2], "c")}, {_LAST}
SELECT 0::BIGINT AS qid, round(sum(o.n * (l.n / l.d_l_orderkey) * least(1.0, l.d_l_orderkey / o.d_o_orderkey)), 3) AS estimate FROM f_a_orders o JOIN f_a_lineitem l ON o.b_o_orderkey = l.b_l_orderkey
UNION ALL SELECT 1, round(sum(o.n * (l.n / l.d_l_orderkey) * (c.n / c.d_c_custkey) * least(1.0, l.d_l_orderkey / o.d_o_orderkey, c.d_c_custkey / o.d_o_custkey)), 3) FROM f_b_orders o JOIN f_b_lineitem l ON o.b_o_orderkey = l.b_l_orderkey JOIN f_b_customer c ON o.b_o_custkey = c.b_c_custkey
UNION ALL SELECT 2, round(sum(c.n * (m.n / m.d) * least(1.0, m.d / c.d_c_custkey)), 3) FROM f_c_customer c JOIN m ON c.b_c_custkey = m.b_o_custkey"""
)
def trained_join_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered joins of two and three tables from a model with independent leaves in each cell."""
    model = JoinModel.fit(_join_tables(spark, sf_dir), JOINS, FILTERS, Setting(WIDTH, 0), by="independent")
    return model.estimates(_asked(spark)).select("qid", F.round("estimate", 3).alias("estimate"))


@_add()
def learned_join_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same joins from trees learned in each cell, with special values."""
    tables = _join_tables(spark, sf_dir)
    boxes = {t: np.array([[q.boxes.get(t, {}).get(c, (-np.inf, np.inf)) for c in FILTERS[t]] for q in JOIN_QUERIES]) for t in tables}
    return JoinModel.fit(tables, JOINS, FILTERS, Setting(5000.0, 20), boxes).estimates(_asked(spark))


#: Side by l_quantity: rows are nearest to the centre 13 or to the centre 38, so up to 25, and from 26 on.
_TWO = f"""{_DUCK}, rs AS (SELECT *, CASE WHEN l_quantity <= 25.5 THEN 0 ELSE 1 END AS side FROM lineitem), sz AS (SELECT side, count(*) AS n FROM rs GROUP BY side),
lv AS ({" UNION ALL ".join(f"SELECT side, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM rs" for c in COLUMNS)}),
bx AS (SELECT side, col, min(v) AS lo, max(v) AS hi FROM lv GROUP BY side, col),
cn AS (SELECT side, col, v, count(*) AS n FROM lv GROUP BY side, col, v), dm AS (SELECT DISTINCT col, v FROM cn),
j AS (SELECT s.side, dm.col, dm.v, coalesce(cn.n, 0) AS n FROM (SELECT side FROM sz) s, dm LEFT JOIN cn ON cn.side = s.side AND cn.col = dm.col AND cn.v = dm.v),
f AS (SELECT *, CASE WHEN n > 0 OR coalesce(lag(n) OVER (PARTITION BY side, col ORDER BY v), 1) > 0 THEN 1 ELSE 0 END AS st FROM j),
g AS (SELECT *, sum(st) OVER (PARTITION BY side, col ORDER BY v) AS run FROM f),
h AS (SELECT side, col, min(v) AS lo, max(v) AS hi, sum(n) AS n FROM g GROUP BY side, col, run),
pd AS (SELECT side, col, lo, hi, CAST(n + 1 AS DOUBLE) / (sum(n) OVER (PARTITION BY side, col) + count(*) OVER (PARTITION BY side, col)) AS pdf FROM h),
pr AS (SELECT w.qid, s.side, w.col, CASE WHEN any_value(bx.lo) > any_value(w.hi) OR any_value(bx.hi) < any_value(w.lo) THEN 0 ELSE coalesce(sum(pdf) FILTER (WHERE pd.lo <= w.hi AND pd.hi >= w.lo), 0) END AS p
 FROM w, (SELECT side FROM sz) s JOIN bx ON bx.side = s.side JOIN pd ON pd.side = s.side WHERE bx.col = w.col AND pd.col = w.col GROUP BY w.qid, s.side, w.col),
tp AS (SELECT qid, side, product(p) AS p FROM pr GROUP BY qid, side)"""


@_add(f"{_TWO} SELECT qid, round(sum(tp.p * sz.n) / (SELECT count(*) FROM lineitem), 9) AS p FROM tp JOIN sz ON tp.side = sz.side GROUP BY qid")
def fixed_tree_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of two row clusters, each with independent leaves, over all rows."""
    sides = [Node("product", [0, 1, 2, 3], [Node("leaf", [c]) for c in range(4)], "data") for _ in range(2)]
    root = Node("sum", [0, 1, 2, 3], sides, centres=[[13.0, 0.0, 0.0, 0.0], [38.0, 0.0, 0.0, 0.0]], fill=[0.0] * 4)
    for i, node in enumerate(root.walk()):
        node.number = i
    model = Model.fit(_table(spark, sf_dir, "lineitem"), COLUMNS, np.zeros((0, 4, 2)), root=root)
    return model.estimate(range_workload(spark)).select("qid", F.round("p", 9).alias("p"))


@_add(
    f"""{_TWO}, gb AS (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) AS n FROM lineitem GROUP BY 1), gp AS (SELECT v, CASE WHEN v <= 25.5 THEN 0 ELSE 1 END AS side, CAST(n + 1 AS DOUBLE) / (sum(n) OVER () + count(*) OVER ()) AS pdf FROM gb),
ql AS (SELECT qid, max(lo) FILTER (WHERE col = 'l_quantity') AS lo, max(hi) FILTER (WHERE col = 'l_quantity') AS hi FROM w GROUP BY qid),
pl AS (SELECT ql.qid, s.side, CASE WHEN ql.lo IS NULL THEN (SELECT n FROM sz WHERE sz.side = s.side) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) ELSE coalesce((SELECT sum(pdf) FROM gp WHERE gp.side = s.side AND v BETWEEN ql.lo AND ql.hi), 0) END AS p FROM ql, (SELECT side FROM sz) s),
rr AS (SELECT w.qid, s.side, w.col, coalesce(sum(pdf) FILTER (WHERE pd.lo <= w.hi AND pd.hi >= w.lo), 0) AS p FROM w, (SELECT side FROM sz) s JOIN pd ON pd.side = s.side WHERE w.col <> 'l_quantity' AND pd.col = w.col GROUP BY w.qid, s.side, w.col),
rt AS (SELECT qid, side, product(p) AS p FROM rr GROUP BY qid, side)
SELECT pl.qid, round(sum(pl.p * coalesce(rt.p, 1)), 9) AS p FROM pl LEFT JOIN rt ON pl.qid = rt.qid AND pl.side = rt.side GROUP BY pl.qid"""
)
def factorize_tree_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree whose root models three columns given the box of the fourth, over all rows."""
    boxes = [Node("product", [1, 2, 3], [Node("leaf", [c]) for c in (1, 2, 3)], "data") for _ in range(2)]
    inf = float("inf")
    root = Node("factorize", [0, 1, 2, 3], [Node("leaf", [0]), *boxes], given=[0], ranges=[[[-inf, 25.5]], [[25.5, inf]]])
    for i, node in enumerate(root.walk()):
        node.number = i
    model = Model.fit(_table(spark, sf_dir, "lineitem"), COLUMNS, np.zeros((0, 4, 2)), root=root)
    return model.estimate(range_workload(spark)).select("qid", F.round("p", 9).alias("p"))

"""Workloads as DataFrames: range queries in long form, join queries in structs, update streams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_SCHEMA = "qid long, col string, lo double, hi double"


def from_boxes(spark: SparkSession, boxes: np.ndarray, columns: Sequence[str]) -> DataFrame:
    """An array (queries, columns, 2) of closed bounds, infinite where there is none, in long form: bounded columns only."""
    q, c = np.nonzero(np.isfinite(boxes).any(axis=2))
    rows = [(int(i), columns[j], float(boxes[i, j, 0]), float(boxes[i, j, 1])) for i, j in zip(q, c, strict=True)]
    return spark.createDataFrame(rows, RANGE_SCHEMA)


def from_updates(spark: SparkSession, statements: np.ndarray) -> DataFrame:
    """Same array for a stream of statements; one whose upper bounds are all -1 inserts its lower bounds as a row."""
    rows = [(i, bool((x[:, 1] == -1).all()), x[:, 0].tolist(), x[:, 1].tolist()) for i, x in enumerate(np.asarray(statements, float))]
    return spark.createDataFrame(rows, "seq long, is_insert boolean, lo array<double>, hi array<double>")


def parse_joins(lines: DataFrame, column: str = "value") -> DataFrame:
    """`t1,t2#t1.a=t2.b#t1.x,>,5,t2.y,=,3#123` as (qid, tables, joins, preds, card); the second and third part may be empty."""
    part = F.split(column, "#")
    words = lambda i: F.filter(F.split(part[i], ","), lambda x: F.length(F.trim(x)) > 0)
    joins = F.transform(words(1), lambda j: F.struct(F.trim(F.split(j, "=")[0]).alias("l"), F.trim(F.split(j, "=")[1]).alias("r")))
    triple = words(2)
    preds = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(triple) - 1, F.lit(0))), lambda i: (i % 3 == 0) & (i < F.size(triple))), lambda i: F.struct(F.split(F.get(triple, i), r"\.")[0].alias("tbl"), F.split(F.get(triple, i), r"\.")[1].alias("col"), F.trim(F.get(triple, i + 1)).alias("op"), F.get(triple, i + 2).cast("double").alias("val")))
    rows = lines.select(*([F.col("qid")] if "qid" in lines.columns else [F.monotonically_increasing_id().alias("qid")]), F.transform(words(0), F.trim).alias("tables"), joins.alias("joins"), preds.alias("preds"), part[3].cast("long").alias("card"))
    return rows


#: The comparison operators of predicates.
OPERATORS = ("=", "<", "<=", ">", ">=")


def normalise(queries: DataFrame, step: float = 1.0) -> DataFrame:
    """Predicates as one closed interval for each query, table and column; strict bounds move by `step` (1 for integer columns). Repeated predicates intersect; `empty` says that nothing can match. Unknown operators raise."""
    pred = queries.select("qid", F.explode("preds").alias("p")).select("qid", "p.tbl", "p.col", "p.op", "p.val")
    known = F.col("op").isin(*OPERATORS)
    checked = F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operator "), F.col("op"))).cast("string"))
    pred = pred.withColumn("op", checked)
    lo = F.when(F.col("op").isin("=", ">="), F.col("val")).when(F.col("op") == ">", F.col("val") + step).otherwise(F.lit(float("-inf")))
    hi = F.when(F.col("op").isin("=", "<="), F.col("val")).when(F.col("op") == "<", F.col("val") - step).otherwise(F.lit(float("inf")))
    out = pred.groupBy("qid", "tbl", "col").agg(F.max(lo).alias("lo"), F.min(hi).alias("hi"))
    return out.withColumn("empty", F.col("lo") > F.col("hi"))


def table_variants(queries: DataFrame, nullable: dict[str, dict[str, str]]) -> DataFrame:
    """Routes a table to the variant that keeps rows with a NULL in a key the query does not join on. nullable: table -> {key column: variant name}; a variant drops no rows for that key."""
    tables = F.col("tables")
    joined = F.flatten(F.transform("joins", lambda j: F.array(j["l"], j["r"])))

    def name(t):
        out = t
        for table, keys in nullable.items():
            for key, variant in keys.items():
                out = F.when((t == table) & ~F.array_contains(joined, f"{table}.{key}"), F.lit(variant)).otherwise(out)
        return out

    rename = lambda ref: F.concat_ws(".", name(F.split(ref, r"\.")[0]), F.split(ref, r"\.")[1])
    return queries.select("qid", F.transform(tables, name).alias("tables"), F.transform("joins", lambda j: F.struct(rename(j["l"]).alias("l"), rename(j["r"]).alias("r"))).alias("joins"), F.transform("preds", lambda p: F.struct(name(p["tbl"]).alias("tbl"), p["col"].alias("col"), p["op"].alias("op"), p["val"].alias("val"))).alias("preds"), "card")

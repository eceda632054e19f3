"""Table scans: numeric coercion, NULL join keys, and seeded synthetic tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numeric_table(df: DataFrame, columns: Iterable[str], keys: Iterable[str] = ()) -> DataFrame:
    """The columns a workload touches, as nullable doubles (what is not a number is NULL); rows with a NULL in a join key are dropped."""
    wanted = list(dict.fromkeys([*keys, *columns]))
    out = df.select(*[F.col(c).try_cast("double").alias(c) for c in wanted])
    nan_free = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in wanted]
    return out.select(*nan_free).na.drop(subset=list(keys)) if keys else out.select(*nan_free)


def csv_table(spark: SparkSession, path: str, columns: Iterable[str], keys: Iterable[str] = ()) -> DataFrame:
    return numeric_table(spark.read.csv(path, header=True), columns, keys)


def pieces(df: DataFrame, order: str, parts: int) -> DataFrame:
    """Contiguous pieces of about equal size by value range, numbered from 0: cut points come from percentiles, so nothing is sorted whole."""
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(100_000))).first()[0] if parts > 1 else []
    piece = sum((F.when(F.col(order) > F.lit(c), 1).otherwise(0) for c in cuts or []), F.lit(0))
    return df.withColumn("piece", piece)


def _uniform(n: int, seed: int):
    return F.floor(F.rand(seed) * n).cast("double")


def _choice(share: float, seed: int):
    return F.when(F.rand(seed) < share, 0.0).otherwise(1.0)


def toy(spark: SparkSession, name: str, rows: int = 500_000, seed: int = 0) -> DataFrame:
    """Seeded synthetic tables with columns of known dependence. Later columns refer to earlier ones."""
    s = seed * 1000
    u, c = (lambda n, k: _uniform(n, s + k)), (lambda p, k: _choice(p, s + k))
    normal = lambda m, sd, k: F.randn(s + k) * sd + m
    three = lambda a, b, k: F.when(F.rand(s + k) < a, 0.0).when(F.rand(s + k) < a + b, 1.0).otherwise(2.0)
    spread = {"totally_iclr": 0.0, "highly_iclr": 0.1, "medium_iclr": 0.4, "slightly_iclr": 0.8, "independent_iclr": 1.0}
    tables = {
        "highly_correlated_cont": {"a1": normal(0, 20, 1), "a2": normal(0, 20, 2), "a3": "a1+a2", "a4": "2.5*a1+5", "a5": "2.5*a2+5", "a6": "a1*a1/100+a5", "a7": F.expr("a1+a4") + normal(0, 2, 3), "a8": "a3+a5+a6+a7"},
        "slightly_correlated_cont": {"a1": u(10, 1), "a2": u(3, 2), "a3": F.expr("a1+a2") + c(0.8, 3), "a4": normal(10, 20, 4), "a5": F.expr("2.5*a4") + normal(0, 3, 5), "a6": u(10, 6) * u(10, 6) + u(3, 7) * F.col("a4") / 100, "a7": F.expr("a4/2+a1/2") + normal(0, 3, 8), "a8": F.expr("2*a3+a4") + normal(0, 3, 9)},
        "independent_cont": {"a1": u(10, 1), "a2": normal(0, 20, 2), "a3": u(50, 3), "a4": normal(10, 20, 4), "a5": normal(5, 3, 5), "a6": u(3, 6), "a7": normal(0, 1, 7), "a8": u(100, 8)},
        "highly_correlated_cat": {"a1": u(10, 1), "a2": F.col("a1") + c(0.9, 2), "a3": "a1+a2", "a4": F.col("a3") + three(0.8, 0.1, 3), "a5": "a3+a4", "a6": F.expr("2*a2") + u(10, 4), "a7": "a1+10", "a8": "a1+a4+a5+a7"},
        "medium_correlated_cat": {"a1": u(10, 1), "a2": F.col("a1") + c(0.7, 2), "a3": "a1+a2", "a4": F.col("a3") + u(3, 3), "a5": u(20, 4), "a6": F.col("a5") + c(0.7, 5), "a7": "a5+a6", "a8": F.col("a7") + u(3, 6), "a9": u(40, 7), "a10": u(15, 8)},
        "slightly_correlated_cat": {"a1": u(10, 1), "a2": u(10, 2), "a3": F.expr("a1+a2") + c(0.7, 3), "a4": F.col("a1") + three(0.7, 0.2, 4), "a5": u(40, 5), "a6": F.expr("a5+a4") + c(0.7, 6), "a7": F.col("a2") + c(0.7, 7), "a8": u(100, 8)},
        "independent_cat": {f"a{i}": u(n, i) + (3 if i == 3 else 0) for i, n in enumerate((10, 11, 21, 24, 45, 13, 58, 137), 1)},
    }
    if name in spread:
        p = spread[name]
        tables[name] = {"a1": u(10, 1)} | {f"a{i}": F.when(F.rand(s + 50 + i) < p, u(10, i)).otherwise(F.col("a1")) for i in range(2, 11)}
    df = spark.range(rows).select()
    for column, value in tables[name].items():
        df = df.withColumn(column, F.expr(value) if isinstance(value, str) else value)
    return df


TOYS = ("highly_correlated_cont", "slightly_correlated_cont", "independent_cont", "highly_correlated_cat", "medium_correlated_cat", "slightly_correlated_cat", "independent_cat", "totally_iclr", "highly_iclr", "medium_iclr", "slightly_iclr", "independent_iclr")

"""What a learner knows of columns before it learns: types, domains, one-hot and scaled forms, principal components."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MetaType(Enum):
    REAL = 1
    BINARY = 2
    DISCRETE = 3


#: Types of columns and the kind of leaf each has.
TYPES = {
    "REAL": MetaType.REAL,
    "INTERVAL": MetaType.REAL,
    "POSITIVE": MetaType.REAL,
    "CATEGORICAL": MetaType.DISCRETE,
    "ORDINAL": MetaType.DISCRETE,
    "COUNT": MetaType.DISCRETE,
    "BINARY": MetaType.BINARY,
}
#: Fixed value: distinct values up to which a column can be grouped by.
GROUPABLE = 1200


def column_context(df: DataFrame, columns: Sequence[str], kind: str | None = None) -> DataFrame:
    """(col, meta, lo, hi, n_distinct, n_null, groupable), one row for each numeric column, in one pass. meta: of `kind` if given; else BINARY for 0 and 1 only, DISCRETE for whole numbers, REAL for others. Distinct values are counted exactly, by value and column first."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")
    counts = df.select(pairs).select("p.*").groupBy("col", "v").agg(F.count("*").alias("n"))
    whole = F.min((F.col("v") == F.floor("v")).cast("int")) == 1
    found = counts.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n_distinct"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"), whole.alias("whole"))
    binary = F.col("whole") & (F.col("lo") >= 0) & (F.col("hi") <= 1)
    meta = F.lit(TYPES[kind].name) if kind else F.when(binary, "BINARY").when(F.col("whole"), "DISCRETE").otherwise("REAL")
    return found.select("col", meta.alias("meta"), "lo", "hi", "n_distinct", "n_null", (F.col("n_distinct") <= GROUPABLE).alias("groupable"))


def one_hot(column: Column, domain: Sequence) -> Column:
    """array<int>, 1 at the value's place in the domain; a value that is not in it raises, NULL is all 0."""
    known = column.isNull() | column.isin(list(domain))
    bits = F.array(*[F.coalesce((column == F.lit(d)).cast("int"), F.lit(0)) for d in domain])
    return F.when(known, bits).otherwise(F.raise_error(F.concat(F.lit("not in the domain: "), column.cast("string"))).cast("array<int>"))


def prepared(column: Column, how: str | None) -> Column:
    """The value as clustering takes it: None as it is, log1p or sqrt."""
    if how not in (None, "log1p", "sqrt"):
        raise ValueError(how)
    return column.cast("double") if how is None else F.log1p(column.cast("double")) if how == "log1p" else F.sqrt(column.cast("double"))


def term_weights(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as counts of terms, weighted by term frequency in the row times ln((1+rows)/(1+rows with the term)) + 1."""
    head = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c) > 0).alias(c) for c in columns]).first()
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))
    return df.select(*[F.when(total > 0, F.coalesce(F.col(c), F.lit(0)) / total * float(np.log((1 + head.n) / (1 + head[c])) + 1)).otherwise(0.0).alias(c) for c in columns])


def principal_components(df: DataFrame, columns: Sequence[str], share: float = 0.9) -> list[tuple[float, list[float]]]:
    """(share of the variance, direction) of the fewest components that explain at least `share`. One pass adds up the products of the columns; rows with a NULL are left out."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = rows.agg(*[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    matrix = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = found[f"c{i}_{j}"] or 0.0
    value, vector = np.linalg.eigh(matrix)
    order = np.argsort(-value)
    parts = value[order] / max(value.sum(), 1e-300)
    k = int(np.searchsorted(np.cumsum(parts), min(share, 1 - 1e-12))) + 1
    signed = lambda v: v * (1 if v[np.argmax(np.abs(v))] > 0 else -1)
    return [(float(parts[i]), signed(vector[:, order[i]]).tolist()) for i in range(min(k, len(columns)))]


def reduced(df: DataFrame, columns: Sequence[str], components: list[tuple[float, list[float]]]) -> DataFrame:
    """The columns on the components, as c0, c1, ... (not centred: a constant for each component apart)."""
    return df.select(*[sum((F.col(c).cast("double") * w for c, w in zip(columns, direction, strict=True)), F.lit(0.0)).alias(f"c{i}") for i, (_, direction) in enumerate(components)])

"""Factorize nodes: P(left) * P(right | left). Rows are parted into boxes by cuts on the left columns; each box has the joint cells of
the left columns and a histogram of each right column. Both are counted over all rows and are tables of the model's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import leaves


def equal_mass(df: DataFrame, column: str, parts: int) -> list[float]:
    """At most parts-1 cuts: the first values at which the share of rows reaches 1/parts, 2/parts, ..., without repeats. The window sees distinct values."""
    shares = leaves.ecdf(df, column)
    rows = shares.agg(*[F.min(F.when(F.col("ecdf") >= F.lit(i / parts), F.col("v"))).alias(f"c{i}") for i in range(1, parts)]).first() if parts > 1 else ()
    return sorted({v for v in rows if v is not None})


def box_number(cuts: dict[str, Sequence[float]]) -> Column:
    """The number of the box by how many cuts lie below each column's value; NULL is below all."""
    out = F.lit(0)
    for c, at in cuts.items():
        above = F.lit(0)
        for v in at:
            above = above + F.coalesce((F.col(c).cast("double") > F.lit(float(v))).cast("int"), F.lit(0))
        out = out * (len(at) + 1) + above
    return out


@dataclass
class Factorized:
    """left: (cell, box, col, v, n) for each left column of each joint cell; right: histogram bins by box; weights: (box, n)."""

    left_columns: list[str]
    right_columns: list[str]
    left: DataFrame
    right: DataFrame
    weights: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, left: Sequence[str], right: Sequence[str], cuts: dict[str, Sequence[float]]) -> Factorized:
        rows = df.select(box_number(cuts).alias("box"), *[F.col(c).cast("double").alias(c) for c in [*left, *right]])
        cells = rows.groupBy("box", *left).agg(F.count("*").alias("n"))
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("v")) for c in left])).alias("p")
        cell = F.xxhash64("box", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in left]).alias("cell")
        return cls(list(left), list(right), cells.select(cell, "box", "n", pairs).select("cell", "box", "n", "p.col", "p.v"), leaves.histogram(leaves.value_counts(rows, right, ["box"]), by=["box"]), cells.groupBy("box").agg(F.sum("n").alias("n")))

    def estimate(self, workload: DataFrame) -> DataFrame:
        """(qid, estimate) for queries (qid, col, lo, hi): over the boxes, the rows of left cells inside the query times the right columns' probability in that box. The cells and bins belong to the model."""
        is_left, is_right = F.col("col").isin(self.left_columns), F.col("col").isin(self.right_columns)
        asked = workload.groupBy("qid").agg(F.sum(is_left.cast("int")).alias("n_left"), F.sum(is_right.cast("int")).alias("n_right"))
        inside = (F.col("q.col") == F.col("c.col")) & (F.col("c.v") >= F.col("q.lo")) & (F.col("c.v") <= F.col("q.hi"))
        met = workload.alias("q").join(self.left.alias("c"), inside).groupBy("q.qid", "c.box", "c.cell").agg(F.count("*").alias("k"), F.first("c.n").alias("n"))
        some = met.join(asked, "qid").where("k = n_left").groupBy("qid", "box").agg(F.sum("n").alias("n"))
        # A query that bounds no left column has every box whole; the boxes are of the model, and their number is checked.
        if self.weights.count() > 10_000:
            raise ValueError("over 10000 boxes")
        whole = asked.where("n_left = 0").select("qid", F.lit(1).alias("one")).join(F.broadcast(self.weights.withColumn("one", F.lit(1))), "one").select("qid", "box", "n")
        touched = (F.col("q.col") == F.col("b.col")) & (F.col("b.lo") <= F.col("q.hi")) & (F.col("b.hi") >= F.col("q.lo"))
        each = workload.alias("q").join(self.right.alias("b"), touched).groupBy("q.qid", "b.box", "q.col").agg(F.sum(F.col("b.pdf") * F.col("b.non_null")).alias("p"))
        right = each.groupBy("qid", "box").agg(F.product("p").alias("p"), F.count("*").alias("k"))
        joined = some.unionByName(whole).join(asked, "qid").join(right, ["qid", "box"], "left")
        p = F.when(F.col("n_right") == 0, 1.0).when(F.col("k") == F.col("n_right"), F.col("p")).otherwise(0.0)
        found = joined.groupBy("qid").agg(F.sum(F.col("n") * p).alias("estimate"))
        return asked.select("qid").join(found, "qid", "left").select("qid", F.coalesce("estimate", F.lit(0.0)).alias("estimate"))

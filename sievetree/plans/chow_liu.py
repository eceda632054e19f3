"""Tree-shaped Bayesian networks over columns with few values: mutual information from counts over all rows, the heaviest spanning tree, smoothed conditional shares.

Counting is one pass with one exchange. What reaches the driver are the counts of value pairs along the tree's edges, bounded by `most_cells`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dependence import components


def pair_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, a, b, n): how often value a of column i meets value b of column j, for i before j, rows without NULL in the two."""
    pairs = [F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(columns[i]).cast("double").alias("a"), F.col(columns[j]).cast("double").alias("b")) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("a is not null and b is not null").groupBy("i", "j", "a", "b").agg(F.count("*").alias("n"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """(i, j, mi) in nats."""
    total = counts.groupBy("i", "j").agg(F.sum("n").alias("t"))
    left = counts.groupBy("i", "j", "a").agg(F.sum("n").alias("na"))
    right = counts.groupBy("i", "j", "b").agg(F.sum("n").alias("nb"))
    every = counts.join(left, ["i", "j", "a"]).join(right, ["i", "j", "b"]).join(total, ["i", "j"])
    return every.groupBy("i", "j").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))


def spanning_tree(columns: Sequence[str], weights: dict[tuple[str, str], float]) -> dict[str, str | None]:
    """column -> parent of the heaviest spanning tree, the first column being the root; of equal edges the first pair by name."""
    chosen: list[tuple[int, int]] = []
    place = {c: i for i, c in enumerate(columns)}
    for a, b in sorted(weights, key=lambda e: (-weights[e], e)):
        i, j = place[a], place[b]
        label = {c: k for k, g in enumerate(components(len(columns), lambda x, y: (x, y) in chosen or (y, x) in chosen)) for c in g}
        if label[i] != label[j]:
            chosen.append((i, j))
    parent: dict[str, str | None] = {columns[0]: None}
    reach = [0]
    for at in reach:
        for i, j in chosen:
            for x, y in ((i, j), (j, i)):
                if x == at and columns[y] not in parent:
                    parent[columns[y]] = columns[at]
                    reach.append(y)
    return parent


class ChowLiu:
    """P(root) * product of P(column | parent). Values that were never seen have probability 0."""

    def __init__(self, parent: dict[str, str | None], values: dict[str, list[float]], shares: dict[str, np.ndarray]):
        self.parent, self.values, self.shares = parent, values, shares
        self.order = list(parent)
        self.place = {c: {v: k for k, v in enumerate(vs)} for c, vs in values.items()}

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], alpha: float = 0.01, most_cells: int = 1_000_000) -> ChowLiu:
        rows = df.select(*columns).na.drop()
        if len(columns) == 1:
            single = sorted((r.v, r.n) for r in rows.groupBy(F.col(columns[0]).cast("double").alias("v")).agg(F.count("*").alias("n")).limit(most_cells + 1).collect())
            n = np.array([k for _, k in single], float) + alpha
            return cls({columns[0]: None}, {columns[0]: [v for v, _ in single]}, {columns[0]: n / n.sum()})
        counts = pair_counts(rows, columns).cache()
        try:
            parent = spanning_tree(columns, {(r.i, r.j): r.mi for r in mutual_information(counts).collect()})
            edges = [tuple(sorted((c, p), key=list(columns).index)) for c, p in parent.items() if p is not None]
            on_tree = counts.join(F.broadcast(df.sparkSession.createDataFrame(edges, "i string, j string")), ["i", "j"], "left_semi") if edges else counts
            cells = on_tree.limit(most_cells + 1).collect()
        finally:
            counts.unpersist()
        if len(cells) > most_cells:
            raise ValueError("too many value pairs for a Chow-Liu leaf; use histograms for columns of many values")
        values = {c: sorted({r.a for r in cells if r.i == c} | {r.b for r in cells if r.j == c}) for c in columns}
        place = {c: {v: k for k, v in enumerate(vs)} for c, vs in values.items()}
        shares: dict[str, np.ndarray] = {}
        for c, p in parent.items():
            if p is None:
                one = next(r for r in cells if c in (r.i, r.j)) if cells else None
                n = np.full(len(values[c]), alpha)
                for r in cells:
                    if one is not None and (r.i, r.j) == (one.i, one.j):
                        n[place[c][r.a if r.i == c else r.b]] += r.n
                shares[c] = n / n.sum() if len(n) else n
            else:
                table = np.full((len(values[p]), len(values[c])), alpha)
                for r in cells:
                    if {r.i, r.j} == {c, p}:
                        x, y = (r.a, r.b) if r.i == p else (r.b, r.a)
                        table[place[p][x], place[c][y]] += r.n
                shares[c] = table / table.sum(1, keepdims=True) if table.size else table
        return cls(parent, values, shares)

    def _up(self, evidence: dict[str, float], fold) -> tuple[float, dict[str, np.ndarray]]:
        """The fold of the whole tree, and for each column what its subtree gives to each of its parent's values."""
        below = {c: np.ones(len(self.values[c])) for c in self.order}
        for c in self.order:
            if evidence.get(c) is not None and not math.isnan(evidence[c]):
                mask = np.zeros(len(self.values[c]))
                if (k := self.place[c].get(evidence[c])) is not None:
                    mask[k] = 1.0
                below[c] = mask
        for c in reversed(self.order):
            if (p := self.parent[c]) is not None:
                below[p] = below[p] * fold(self.shares[c] * below[c], axis=1)
        root = self.order[0]
        return float(fold(self.shares[root] * below[root])), below

    def probability(self, evidence: dict[str, float]) -> float:
        """Of the given values; columns without one, or with NaN, are summed out."""
        return self._up(evidence, np.sum)[0]

    def most_probable(self, evidence: dict[str, float]) -> dict[str, float]:
        """Values of all columns with the highest joint probability that keep the evidence; of equals the smallest."""
        best, below = self._up(evidence, np.max)
        if best == 0:
            raise ValueError("the evidence has probability 0")
        at: dict[str, int] = {}
        for c in self.order:
            p = self.parent[c]
            at[c] = int(np.argmax((self.shares[c] if p is None else self.shares[c][at[p]]) * below[c]))
        return {c: self.values[c][k] for c, k in at.items()}

    def draw(self, n: int, seed: int = 0) -> np.ndarray:
        """Rows drawn from the root down; columns in the tree's order."""
        rng = np.random.default_rng(seed)
        at: dict[str, np.ndarray] = {}
        for c in self.order:
            p = self.parent[c]
            cdf = np.cumsum(self.shares[c], axis=-1)
            chosen = np.broadcast_to(cdf, (n, len(cdf))) if p is None else cdf[at[p]]
            at[c] = np.minimum((rng.random((n, 1)) >= chosen).sum(1), len(self.values[c]) - 1)
        return np.column_stack([np.array(self.values[c])[at[c]] for c in self.order])

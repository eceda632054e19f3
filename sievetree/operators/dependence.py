"""Dependence and splitting on a bounded sample: randomized dependence coefficients, components, two-means. Pure numpy on the driver or in a task; what these decide is then applied to all rows by plans.tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Random features for each column, their scale, and the seed of the projection.
FEATURES, SCALE, SEED = 10, 1 / 6, 17


def ranks(x: np.ndarray) -> np.ndarray:
    """Share of values at or below each value; NaN is 0."""
    out = np.zeros(len(x))
    known = np.isfinite(x)
    out[known] = np.searchsorted(np.sort(x[known]), x[known], "right") / max(len(x), 1)
    return out


def features(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    copula = np.column_stack([ranks(x), np.ones(len(x))])
    return np.column_stack([np.sin(copula @ (rng.standard_normal((2, FEATURES)) * SCALE / 2)), np.ones(len(x))])


def canonical(a: np.ndarray, b: np.ndarray) -> float:
    """First canonical correlation: the largest singular value between the orthonormal bases of the centred blocks."""
    bases = []
    for block in (a, b):
        u, s, _ = np.linalg.svd(block - block.mean(0), full_matrices=False)
        bases.append(u[:, s > 1e-6 * max(s[0], 1e-12)] if len(s) and s[0] > 1e-9 else u[:, :0])
    if not bases[0].shape[1] or not bases[1].shape[1]:
        return 0.0
    return float(min(1.0, np.linalg.svd(bases[0].T @ bases[1], compute_uv=False)[0]))


def rdc(rows: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    blocks = [features(rows[:, i], rng) for i in range(rows.shape[1])]
    out = np.eye(len(blocks))
    for i in range(len(blocks)):
        for j in range(i):
            out[i, j] = out[j, i] = canonical(blocks[i], blocks[j])
    return out


def rdc_by_slice(df: DataFrame, columns: Sequence[str], by: str, most: int = 50_000) -> DataFrame:
    """(by, i, j, rdc) for each slice, on about `most` of its rows at most (at random), a task a slice."""
    share = df.groupBy(by).agg(F.count("*").alias("__n"))
    sample = df.select(by, *[F.col(c).cast("double").alias(c) for c in columns], F.rand(SEED).alias("__u")).join(F.broadcast(share), by).where(F.col("__u") * F.col("__n") <= most)

    def one(table: pa.Table) -> pa.Table:
        matrix = rdc(np.column_stack([table.column(c).to_numpy(zero_copy_only=False) for c in columns]))
        pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
        return pa.table({by: pa.array([table.column(by)[0].as_py()] * len(pairs), table.schema.field(by).type), "i": pa.array([columns[i] for i, _ in pairs]), "j": pa.array([columns[j] for _, j in pairs]), "rdc": pa.array([matrix[i, j] for i, j in pairs], pa.float64())})

    kind = dict(df.dtypes)[by]
    return sample.groupBy(by).applyInArrow(one, f"{by} {kind}, i string, j string, rdc double")


def components(n: int, linked) -> list[list[int]]:
    label = list(range(n))

    def find(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    groups: dict[int, list[int]] = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def two_means(rows: np.ndarray, k: int = 2, seed: int = SEED, rounds: int = 30) -> np.ndarray:
    """Centres; missing values count as the column's mean. Starts far apart, so it is the same at every run."""
    x = impute(rows)
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[int(d.argmax())])
    at = np.array(centres)
    for _ in range(rounds):
        label = nearest(x, at)
        new = np.array([x[label == i].mean(0) if (label == i).any() else at[i] for i in range(k)])
        if np.allclose(new, at):
            break
        at = new
    return at


def impute(rows: np.ndarray) -> np.ndarray:
    known = np.isfinite(rows)
    mean = np.where(known, rows, 0).sum(0) / np.maximum(known.sum(0), 1)
    return np.where(known, rows, mean)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin([((rows - c) ** 2).sum(1) for c in centres], axis=0)


def median_split(df: DataFrame, column: str) -> DataFrame:
    """Rows with `side`: 0 at or below the column's exact median, 1 above; NULLs go to 0."""
    middle = df.agg(F.median(column)).first()[0]
    return df.withColumn("side", F.when(F.col(column) > F.lit(middle), 1).otherwise(0))


def centre_split(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """Rows with `side`, the nearest of the stored centres, the first of equals."""
    far = [sum(((F.col(c).cast("double") - F.lit(float(v))) * (F.col(c).cast("double") - F.lit(float(v))) for c, v in zip(columns, centre, strict=True)), F.lit(0.0)) for centre in centres]
    ordered = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far)]))
    return df.withColumn("side", ordered["i"])


def boxes(df: DataFrame, columns: Sequence[str], by: str = "side") -> DataFrame:
    """(by, col, lo, hi, n): the smallest box around each part, for pruning."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")
    return df.select(by, pairs).groupBy(by, "p.col").agg(F.min("p.v").alias("lo"), F.max("p.v").alias("hi"), F.count("*").alias("n"))


def prune(sides: DataFrame, workload: DataFrame, by: str = "side") -> DataFrame:
    """(qid, by, verdict): 0 if the query misses the part's box, 1 if it covers it, else -1 (look inside). Both tables belong to a model and a query set."""
    pairs = workload.alias("q").join(F.broadcast(sides.alias("s")), F.col("q.col") == F.col("s.col"))
    missed = (F.col("q.lo") > F.col("s.hi")) | (F.col("q.hi") < F.col("s.lo"))
    covered = (F.col("q.lo") <= F.col("s.lo")) & (F.col("q.hi") >= F.col("s.hi"))
    return pairs.groupBy("q.qid", f"s.{by}").agg(F.when(F.max(missed.cast("int")) == 1, 0).when(F.min(covered.cast("int")) == 1, 1).otherwise(-1).alias("verdict"))


def batches_to_rows(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])

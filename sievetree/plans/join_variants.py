"""Other scalings of a join over binned keys. Each key's children bring rows and distinct keys per bin; the variants differ in what they take as the chance that keys meet.

All are column arithmetic on cells of key bins; nothing touches base rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANTS = ("independent", "easy", "double_easy", "ndv", "double_ndv", "least_ndv", "one_least_ndv")


@dataclass
class Key:
    """A key of the cells: its bin's width, the cells' distinct keys, and (rows, distinct keys) of each child joined on it."""

    width: float
    ndv: Column
    children: list[tuple[Column, Column]]


def _damped(ratios: list[Column], ascending: bool = True) -> Column:
    """The product of the sorted ratios, the k-th to the power 1/k."""
    ordered = F.sort_array(F.array(*ratios), asc=ascending)
    powered = F.transform(ordered, lambda x, i: F.pow(x, F.lit(1.0) / (i + 1)))
    return F.aggregate(powered, F.lit(1.0), lambda a, x: a * x)


def _product(parts: list[Column]) -> Column:
    out = F.lit(1.0)
    for p in parts:
        out = out * p
    return out


def scaled(n: Column, p: Column, keys: list[Key], how: str) -> Column:
    """Rows of a cell after its joins.

    independent: every child row meets with 1/width. easy: the widths' powers by their number of children, damped, widest first.
    double_easy: a key's children damped too, its k-th by the power 1/(k+1). ndv: rows per distinct key, and the share of the bin that a child's keys fill,
    damped. double_ndv: the cell's own keys among those shares, damped inside a key and over keys. least_ndv: the smallest number of
    distinct keys over the cell's own, damped over keys. one_least_ndv: only the smallest of those counts.
    """
    own = n * p
    rows = _product([c for k in keys for c, _ in k.children])
    fan = _product([c / d for k in keys for c, d in k.children])
    if how == "independent":
        return own * rows / _product([F.lit(float(k.width)) for k in keys for _ in k.children])
    if how == "easy":
        ordered = sorted(keys, key=lambda k: -k.width)
        return own * rows / _product([F.lit(float(k.width) ** (len(k.children) / i)) for i, k in enumerate(ordered, 1)])
    if how == "double_easy":
        single = [_damped_width(k) for k in keys]
        ordered = sorted(single, reverse=True)
        return own * rows / _product([F.lit(w ** (1 / i)) for i, w in enumerate(ordered, 1)])
    shares = [[d / F.lit(float(k.width)) for _, d in k.children] for k in keys]
    if how == "ndv":
        return own * fan * _damped([s for part in shares for s in part])
    if how == "double_ndv":
        return own * fan * _damped([_damped([k.ndv / F.lit(float(k.width)), *part]) for k, part in zip(keys, shares, strict=True)])
    least = [F.least(F.lit(1.0), *[d / k.ndv for _, d in k.children]) for k in keys]
    if how == "least_ndv":
        return own * fan * _damped(least)
    if how == "one_least_ndv":
        return own * fan * (F.least(*least) if len(least) > 1 else least[0])
    raise ValueError(f"no variant {how}")


def _damped_width(key: Key) -> float:
    out = 1.0
    for j in range(2, len(key.children) + 2):
        out *= float(key.width) ** (1 / j)
    return out


def merge_rows(parts: DataFrame, key: str) -> DataFrame:
    """Cells projected on a key: rows add up, distinct keys are not kept."""
    return parts.groupBy(f"bin_{key}").agg(F.sum("n").alias("n"))


def merge_most(parts: DataFrame, key: str) -> DataFrame:
    """Cells projected on a key: rows add up, of the distinct keys the most."""
    return parts.groupBy(f"bin_{key}").agg(F.sum("n").alias("n"), F.max(f"ndv_{key}").alias(f"ndv_{key}"))


def dynamic_factor(a: Column, b: Column, share: Column) -> Column:
    """Between the bounds a and b by the exponent `share`: a^(1-share) * b^share."""
    return F.pow(a, 1 - share) * F.pow(b, share)


def sampled(df: DataFrame, condition: Column, ratio: float = 0.1, seed: int = 17) -> DataFrame:
    """(estimate, sampled): rows that the condition holds for, from a share of the rows; the sampling baseline. At least 1."""
    rows = df.sample(False, ratio, seed).agg(F.count("*").alias("sampled"), F.coalesce(F.sum(F.coalesce(condition.cast("long"), F.lit(0))), F.lit(0)).alias("hit"))
    return rows.select(F.greatest(F.lit(1.0), F.rint(F.col("hit") / F.lit(ratio))).alias("estimate"), "sampled")

"""Join estimation over binned keys: partition statistics, special values, recursive combination, merging; and bucket bounds.

A table is a row for each combination of key bins, with its rows and distinct keys; special values, keys whose joins are largest,
can have bins of their own of width 1. `estimate` counts each table's filter exactly, by a scan of the table for every query;
`join_train` keeps models in its place and scans nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_bin(key: Column, width: float, low: float = 0.0) -> Column:
    return F.floor((key - F.lit(low)) / F.lit(float(width))).cast("long")


def ranked(special: DataFrame) -> DataFrame:
    """(v, rank) of special values, from 1; as many rows as special_values was asked for."""
    return special.select("v", F.row_number().over(Window.orderBy(F.desc("size"), "v")).cast("long").alias("rank"))


def special_bin(df: DataFrame, key: str, special: DataFrame, width: float, low: float = 0.0) -> DataFrame:
    """df with `bin_<key>`: minus the rank of a special value (v, rank), else the bin of the key. The special values are a bounded top list, so they go to every task."""
    s = F.broadcast(special.select(F.col("v").alias("__v"), F.col("rank").alias("__rank")))
    return df.join(s, F.col(key).cast("long") == F.col("__v"), "left").withColumn(f"bin_{key}", F.coalesce(-F.col("__rank"), key_bin(F.col(key), width, low))).drop("__v", "__rank")


def partition_stats(df: DataFrame, keys: dict[str, tuple[float, float]], selected: Column | None = None, special: dict[str, DataFrame] | None = None) -> DataFrame:
    """(bin_<key>, n, ndv_<key>, p) of each cell of key bins; keys: name -> (low, width). p is the share of rows that `selected` holds for. Distinct keys are counted exactly by grouping on the key first, in one more exchange per key, which stays even when one bin is hot."""
    bins = [f"bin_{k}" for k in keys]
    rows = df.na.drop(subset=list(keys)).select(*keys, (F.lit(1.0) if selected is None else F.coalesce(selected.cast("double"), F.lit(0.0))).alias("hit"))
    for k, (low, width) in keys.items():
        rows = special_bin(rows, k, special[k], width, low) if special and k in special else rows.withColumn(f"bin_{k}", key_bin(F.col(k), width, low))
    out = rows.groupBy(*bins).agg(F.count("*").alias("n"), (F.sum("hit") / F.count("*")).alias("p"))
    for k in keys:
        one = rows.groupBy(*bins, k).agg(F.lit(1).alias("one")).groupBy(*bins).agg(F.count("*").alias(f"ndv_{k}"))
        out = out.join(one, bins)
    return out


def special_values(tables: Sequence[tuple[DataFrame, str]], most: int) -> DataFrame:
    """(v, size): the keys of the largest joins, by the product of their row counts in the tables (a table without the key counts 1)."""
    parts = [df.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("long").alias("v")).agg(F.count("*").alias("n")) for df, k in tables]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("v").agg(F.product(F.col("n").cast("double")).alias("size")).orderBy(F.desc("size"), "v").limit(most)


def filtered(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n*p rows, and of ndv distinct keys those with a row left: ndv*(1-(1-p)^(n/ndv))."""
    left = [(F.col(f"ndv_{k}") * (1 - F.pow(1 - F.col("p"), F.col("n") / F.col(f"ndv_{k}")))).alias(f"ndv_{k}") for k in keys]
    return parts.select(*[f"bin_{k}" for k in keys], (F.col("n") * F.col("p")).alias("n"), *left)


def combine(parent: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    """A child's fan-out on a key, bin by bin: rows times the child's rows per key, and at most the child's share of keys. Bins the child lacks are pruned by the join."""
    c = child.select(F.col(f"bin_{child_key}").alias(f"bin_{key}"), F.col("n").alias("c_n"), F.col(f"ndv_{child_key}").alias("c_ndv")).where("c_ndv > 0")
    share = F.least(F.lit(1.0), F.when(F.col(f"ndv_{key}") > 0, F.col("c_ndv") / F.col(f"ndv_{key}")).otherwise(F.lit(1.0)))
    return parent.join(c, f"bin_{key}").withColumn("n", F.col("n") * F.col("c_n") / F.col("c_ndv") * share).drop("c_n", "c_ndv")


def merge(parts: DataFrame, key: str, width: float) -> DataFrame:
    """Cells projected on one key: rows add up, distinct keys as of independent draws: w*(1-prod(1-ndv/w)); bins of special values, below 0, are one key wide."""
    w = F.when(F.col(f"bin_{key}") < 0, 1.0).otherwise(float(width))
    free = F.product(F.greatest(1 - F.col(f"ndv_{key}") / w, F.lit(0.0)))
    out = parts.groupBy(f"bin_{key}").agg(F.sum("n").alias("n"), free.alias("free"))
    return out.select(f"bin_{key}", "n", (w * (1 - F.col("free"))).alias(f"ndv_{key}"))


def estimate(tables: dict[str, tuple[DataFrame, dict[str, tuple[float, float]], Column | None]], joins: Sequence[tuple[str, str, str, str]], root: str | None = None, special: dict[str, DataFrame] | None = None) -> DataFrame:
    """special: for each join key of every table (by column name) its class's special values (v, rank), the same in all tables of the class. One row, `estimate`, of an acyclic equi-join. tables: name -> (rows, keys with (low, width), predicate); joins: (table, key, table, key)."""
    if len(joins) != len(tables) - 1:
        raise ValueError("the join must be a tree")
    root = root or list(tables)[-1]
    seen = {root}

    def solve(name: str, up: str | None) -> DataFrame:
        df, keys, predicate = tables[name]
        used = [k for k in keys if any((a, ka) == (name, k) or (b, kb) == (name, k) for a, ka, b, kb in joins)]
        parts = filtered(partition_stats(df, {k: keys[k] for k in used}, predicate, special), used)
        for a, ka, b, kb in joins:
            for (me, my_key), (other, other_key) in (((a, ka), (b, kb)), ((b, kb), (a, ka))):
                if me == name and other not in seen:
                    seen.add(other)
                    parts = combine(parts, my_key, solve(other, other_key), other_key)
        return parts if up is None else merge(parts, up, keys[up][1])

    total = solve(root, None).agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("estimate"))
    if seen != set(tables):
        raise ValueError("the join must be a tree")
    return total


def bucket_stats(df: DataFrame, key: str, buckets: int, low: float, high: float) -> DataFrame:
    """(bucket, n, mcv, mcv_n, ndv): rows, commonest key (the smallest of equals), its rows, distinct keys."""
    place = F.floor((F.col(key) - low) / (high - low + 1) * buckets).cast("long")
    counts = df.where(F.col(key).isNotNull()).groupBy(place.alias("bucket"), F.col(key).cast("long").alias("v")).agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", (-F.col("v")).alias("minus")))
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"), (-top["minus"]).alias("mcv"), top["n"].alias("mcv_n"), F.count("*").alias("ndv"))


def bucket_bound(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket, bound): mcv_a * mcv_b * min(n_a/mcv_a, n_b/mcv_b), at least the join's rows in the bucket."""
    x, y = a.alias("x"), b.alias("y")
    bound = F.col("x.mcv_n") * F.col("y.mcv_n") * F.least(F.col("x.n") / F.col("x.mcv_n"), F.col("y.n") / F.col("y.mcv_n"))
    return x.join(y, "bucket").select("bucket", bound.alias("bound"))


def eliminate(tables: Sequence[DataFrame], share: float = 1.0) -> DataFrame:
    """(bucket, estimate) of an equi-join of any number of tables on one key, from their bucket statistics; buckets that a table lacks fall away.

    bound: the product of the commonest keys' rows times the least n/mcv. even: as if every key had as many rows, the keys of the table
    with the most holding all others'. The estimate lies between them, even^(1-share) * bound^share.
    """
    every = tables[0].select("bucket", "n", "mcv_n", "ndv")
    for t in tables[1:]:
        every = every.unionByName(t.select("bucket", "n", "mcv_n", "ndv"))
    bound = F.product(F.col("mcv_n").cast("double")) * F.min(F.col("n") / F.col("mcv_n"))
    even = F.product(F.col("n") / F.col("ndv")) * F.min("ndv")
    out = every.groupBy("bucket").agg(F.count("*").alias("k"), bound.alias("bound"), even.alias("even")).where(F.col("k") == len(tables))
    return out.select("bucket", (F.pow("even", F.lit(1.0 - share)) * F.pow("bound", F.lit(share))).alias("estimate"))


def whole_table_estimate(parts: Sequence[tuple[DataFrame, float]], share: float = 1.0) -> DataFrame:
    """One row, `estimate`: an equi-join of tables on one key from each one's bucket list and the selectivity that its own model gives its filter."""
    scaled = [bucket_scale(stats, F.lit(float(p))) for stats, p in parts]
    return eliminate(scaled, share).agg(F.coalesce(F.sum("estimate"), F.lit(0.0)).alias("estimate"))


def bucket_stats_by(df: DataFrame, keys: dict[str, tuple[str, float, float]], buckets: int) -> DataFrame:
    """(the buckets, n, mcv_n, ndv) of a table by one or more keys; keys: bucket column -> (key, low, high). mcv_n: rows of the commonest combination of keys."""
    places = [F.floor((F.col(k) - low) / (high - low + 1) * buckets).cast("long").alias(b) for b, (k, low, high) in keys.items()]
    rows = df.na.drop(subset=[k for k, _, _ in keys.values()])
    counts = rows.groupBy(*places, *[F.col(k).alias(f"key_{b}") for b, (k, _, _) in keys.items()]).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("n").alias("mcv_n"), F.count("*").alias("ndv"))


def domain_table(keys: Sequence[Sequence[str]], sizes: Sequence[int]) -> int:
    """Which bucket list drives an elimination: of those with the most keys, the shortest, then the first."""
    return min(range(len(keys)), key=lambda i: (-len(keys[i]), sizes[i], i))


def eliminate_by(lists: Sequence[DataFrame]) -> DataFrame:
    """(the buckets, bound) of an equi-join over several keys, from bucket lists (bucket_..., n, mcv_n, ndv) each with some of the keys: the first list has all. bound: the product of the commonest keys' rows times the least n/mcv; buckets that a list lacks fall away."""
    names = [c for c in lists[0].columns if c.startswith("bucket")]
    out = lists[0].select(*names, F.col("mcv_n").cast("double").alias("top"), (F.col("n") / F.col("mcv_n")).alias("least"))
    for other in lists[1:]:
        own = [c for c in other.columns if c.startswith("bucket")]
        if not set(own) <= set(names):
            raise ValueError("the first list must have every key")
        its = other.select(*own, F.col("mcv_n").cast("double").alias("its_top"), (F.col("n") / F.col("mcv_n")).alias("its_least"))
        out = out.join(its, own).select(*names, (F.col("top") * F.col("its_top")).alias("top"), F.least("least", "its_least").alias("least"))
    return out.select(*names, (F.col("top") * F.col("least")).alias("bound"))


def bucket_filter(stats: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """The buckets that a range of the key reaches."""
    out = stats if first is None else stats.where(F.col("bucket") >= first)
    return out if last is None else out.where(F.col("bucket") <= last)


def bucket_scale(stats: DataFrame, p: Column) -> DataFrame:
    """Buckets of the rows that an independent predicate of selectivity p keeps; a bucket keeps no more keys than rows."""
    n = F.col("n") * p
    return stats.withColumn("ndv", F.least(F.col("ndv").cast("double"), n)).withColumn("mcv_n", F.col("mcv_n") * p).withColumn("n", n)


def bucket_union(parts: Sequence[DataFrame]) -> DataFrame:
    """(bucket, n, mcv_n, ndv) of a table from disjoint parts of its rows: rows add up, and so do the commonest key's rows and the distinct keys, which makes both bounds."""
    every = parts[0].select("bucket", "n", "mcv_n", "ndv")
    for t in parts[1:]:
        every = every.unionByName(t.select("bucket", "n", "mcv_n", "ndv"))
    return every.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "mcv_n", "ndv")])


def paired_keys(weights: dict[tuple[str, str], float], least: float) -> list[tuple[str, ...]]:
    """Key classes in groups of two at most: the most dependent free pair first, while its dependence is `least` or more; the rest alone."""
    taken: set[str] = set()
    out: list[tuple[str, ...]] = []
    for pair in sorted(weights, key=lambda e: (-weights[e], e)):
        if weights[pair] >= least and not taken & set(pair):
            out.append(pair)
            taken |= set(pair)
    return out + [(k,) for k in sorted({k for pair in weights for k in pair} - taken)]


def outer_scatter(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """(k, n_a, n_b, rows, scatter_a, scatter_b): the full outer join by key, already counted: rows it has, and the weight 1/count with which each side's row counts once. Keys are counted before they meet, so a hot key is one row."""
    x = a.groupBy(F.col(key_a).cast("long").alias("k")).agg(F.count("*").alias("n_a")).where("k is not null")
    y = b.groupBy(F.col(key_b).cast("long").alias("k")).agg(F.count("*").alias("n_b")).where("k is not null")
    both = x.join(y, "k", "full").select("k", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    rows = F.greatest("n_a", F.lit(1)) * F.greatest("n_b", F.lit(1))
    share = lambda own, other: F.when(F.col(own) > 0, 1.0 / F.greatest(F.col(other), F.lit(1))).otherwise(0.0)
    return both.select("k", "n_a", "n_b", rows.alias("rows"), share("n_a", "n_b").alias("scatter_a"), share("n_b", "n_a").alias("scatter_b"))

"""What a workload says: masks, co-access, thresholds, query groups, join patterns, true cardinalities, q-errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masks(workload: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(qid, mask): bit i is set if column i is bounded. Up to 63 columns."""
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(1 << i))])
    return workload.where(F.col("col").isin(*columns)).groupBy("qid").agg(F.bit_or(place[F.col("col")].cast("long")).alias("mask"))


def mask_groups(workload: DataFrame, columns: Sequence[str]) -> DataFrame:
    return masks(workload, columns).groupBy("mask").agg(F.count("*").alias("n"))


def coaccess(workload: DataFrame) -> DataFrame:
    """(i, j, w): queries that bound both columns, both ways; the diagonal counts a query twice, and once more if it bounds that column alone. A query's columns are gathered first, so the pairs stay within one query."""
    own = workload.groupBy("qid").agg(F.sort_array(F.collect_set("col")).alias("cols"))
    pair = own.select("cols", F.explode("cols").alias("i")).select("i", F.explode("cols").alias("j"), F.size("cols").alias("n"))
    weight = F.when(F.col("i") != F.col("j"), 1).when(F.col("n") == 1, 3).otherwise(2)
    return pair.groupBy("i", "j").agg(F.sum(weight).cast("long").alias("w"))


def adaptive_threshold(weight: Column, lower: float = 0.1, upper: float = 0.3, steep: float = 5.0) -> Column:
    """exp(-steep*w + k) + b with k and b such that it is `upper` at no co-access and `lower` at full."""
    import math

    scale = (upper - lower) / (1 - math.exp(-steep))
    return F.exp(weight * -steep) * scale + (upper - scale)


def cut_edges(groups: DataFrame, most: int = 10_000) -> DataFrame:
    """Edges between distinct masks: shared columns times the queries of both. The masks are the patterns of a workload, each one row; over `most` of them raise, as a graph of them is too large to cut."""
    if groups.count() > most:
        raise ValueError(f"over {most} patterns of queries")
    a, b = groups.select(F.col("mask").alias("a"), F.col("n").alias("na")), groups.select(F.col("mask").alias("b"), F.col("n").alias("nb"))
    shared = F.bit_count(F.col("a").bitwiseAND(F.col("b")))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", (shared * (F.col("na") + F.col("nb"))).cast("long").alias("w"))


def split_queries(groups: list[tuple[int, int]], heavy: int = 7, least: float = 0.7) -> tuple[list[list[int]], float]:
    """Greedy max-cut of (mask, n): both ends of the heaviest edges part, the others go where they add least. Returns the groups and the share of weight that is cut; one group if that is below `least`."""
    weight = {(a, b): (a & b).bit_count() * (na + nb) for (a, na), (b, nb) in combinations(sorted(groups), 2)}
    total = sum(weight.values())
    if not total:
        return [[m for m, _ in sorted(groups)]], 0.0
    between = lambda m, side: sum(weight[min(m, x), max(m, x)] for x in side)
    sides: list[list[int]] = [[], []]
    placed: dict[int, int] = {}
    order = [m for edge, _ in sorted(weight.items(), key=lambda e: (-e[1], e[0]))[:heavy] for m in edge] + [m for m, _ in sorted(groups, key=lambda g: (-g[1], g[0]))]
    for m in order:
        if m not in placed:
            placed[m] = 0 if between(m, sides[0]) <= between(m, sides[1]) else 1
            sides[placed[m]].append(m)
    cut = sum(w for (a, b), w in weight.items() if placed[a] != placed[b]) / total
    found = [s for s in sides if s]
    return (found, cut) if cut >= least and len(found) > 1 else ([[m for m, _ in sorted(groups)]], cut)


def cut_share(groups: list[tuple[int, int]], sides: list[list[int]]) -> float:
    """Share of the weight between distinct masks (mask, n) that lies between the sides; a mask on no side goes where its columns are shared most."""
    home = {m: i for i, s in enumerate(sides) for m in s}
    place = lambda m: home.get(m, max(range(len(sides)), key=lambda i: (max((m & x).bit_count() for x in sides[i]), -i)))
    weight = {(a, b): (a & b).bit_count() * (na + nb) for (a, na), (b, nb) in combinations(sorted(groups), 2)}
    total = sum(weight.values())
    return sum(w for (a, b), w in weight.items() if place(a) != place(b)) / total if total else 1.0


def true_cardinality(table: DataFrame, workload: DataFrame, batch: int = 200) -> DataFrame:
    """(qid, card) by one scan for each batch of queries: every query is one conditional count of the same aggregation, so there is no join between queries and rows. The workload is a stated query set and is read on the driver."""
    boxes: dict[int, list] = {}
    for r in workload.collect():
        boxes.setdefault(r.qid, []).append(r)
    parts = []
    ids = sorted(boxes)
    for at in range(0, len(ids), batch):
        some = ids[at : at + batch]
        counts = []
        for q in some:
            inside = F.lit(True)
            for r in boxes[q]:
                inside = inside & F.col(r.col).cast("double").between(F.lit(r.lo), F.lit(r.hi))
            counts.append(F.count_if(inside).alias(f"q{q}"))
        one = table.agg(*counts)
        parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(q).cast("long").alias("qid"), F.col(f"q{q}").alias("card")) for q in some])).alias("r")).select("r.*"))
    if not parts:
        return workload.select("qid", F.lit(0).cast("long").alias("card")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def q_errors(estimates: DataFrame) -> DataFrame:
    """(qid, q_error) of rows (qid, estimate, card); queries with no true row are left out."""
    est, card = F.greatest(F.lit(1.0), F.col("estimate").cast("double")), F.col("card").cast("double")
    return estimates.where("card > 0").select("qid", F.greatest(est / card, card / est).alias("q_error"))


def report(errors: DataFrame) -> DataFrame:
    share = lambda p: F.percentile("q_error", F.lit(p))
    return errors.agg(share(0.5).alias("p50"), share(0.9).alias("p90"), share(0.95).alias("p95"), share(0.99).alias("p99"), F.max("q_error").alias("worst"), F.avg("q_error").alias("mean"))


def filter_patterns(queries: DataFrame) -> DataFrame:
    """Queries that filter each column."""
    p = queries.select("qid", F.explode("preds").alias("p")).select("qid", F.concat_ws(".", "p.tbl", "p.col").alias("ref")).distinct()
    return p.groupBy("ref").agg(F.count("*").alias("n"))


def join_patterns(queries: DataFrame) -> DataFrame:
    """Joins by table pair and column pair, whichever side comes first."""
    j = queries.select(F.explode("joins").alias("j")).select(F.least("j.l", "j.r").alias("a"), F.greatest("j.l", "j.r").alias("b"))
    return j.groupBy("a", "b").agg(F.count("*").alias("n"))


def table_patterns(queries: DataFrame) -> DataFrame:
    """Queries in which two tables occur together."""
    t = queries.select("tables", F.explode("tables").alias("a")).select("a", F.explode("tables").alias("b")).where("a < b")
    return t.groupBy("a", "b").agg(F.count("*").alias("n"))


def key_classes(pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Join columns that equi-joins make equal, numbered by their first name. The schema's join graph is small, so union-find runs on the driver."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    roots = sorted({find(x) for x in parent})
    return {x: roots.index(find(x)) for x in sorted(parent)}


def route(query_masks: DataFrame, edge_masks: DataFrame) -> DataFrame:
    """(qid, pos): the child of a query split whose masks cover the query best; one mask that covers it whole wins, then the most shared columns, then the union's, then the first child. edge_masks (pos, mask) is a model's, so it is small."""
    own: dict[int, list[int]] = {}
    for r in edge_masks.collect():
        own.setdefault(r["pos"], []).append(r["mask"])
    shared = lambda m: F.bit_count(F.col("mask").bitwiseAND(F.lit(m).cast("long")))
    union = lambda masks: reduce(lambda a, b: a | b, masks)
    edges = [F.struct(F.lit(p).alias("pos"), F.array_max(F.array(*map(shared, m))).alias("best"), shared(union(m)).alias("some")) for p, m in sorted(own.items())]
    scored = query_masks.select("qid", F.explode(F.array(*edges)).alias("e")).select("qid", "e.*")
    top = Window.partitionBy("qid").orderBy(F.desc("best"), F.desc("some"), "pos")
    return scored.withColumn("rank", F.row_number().over(top)).where("rank = 1").select("qid", "pos")

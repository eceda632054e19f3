"""The tree model: learned from a bounded sample and a workload, its numbers counted over all rows, queried by box.

Structure search (which columns are independent, which queries differ, which rows cluster) sees at most `sample` rows, so it takes
the same time whatever the table. Everything the answers are made of is then counted in one distributed pass over every row: each
batch is routed down the tree, values are counted in the task, and one exchange adds the counts up. A column of at most `max_bins`
distinct values has a bin for each value; of one with more, values are counted by about `max_bins` intervals of equal mass, values that
fill an interval of their own apart, so a leaf is bounded whatever its column. A model is a few Parquet tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import leaves
from ..operators import dependence as dep
from ..operators import splits
from ..operators.workload_stats import split_queries


@dataclass
class Params:
    """least_rows: share of the rows below which no more rows are split. steep, lower, upper: the adaptive threshold. coaccess: weight from which columns count as queried together. by_rows: a name of splits.ROWS; by_columns: rdc or poisson; by_queries: maxcut or kmeans. max_bins: distinct values from which a column is counted by intervals. strong: dependence from which columns are modelled given the others (a factorize node; none above 1); by_conditions: median or grid, where its boxes are cut."""

    sample: int = 50_000
    least_rows: float = 0.01
    steep: float = 5.0
    lower: float = 0.1
    upper: float = 0.3
    coaccess: float = 0.01
    cut: float = 0.7
    by_rows: str = "kmeans"
    by_columns: str = "rdc"
    by_queries: str = "maxcut"
    max_bins: int = 2000
    strong: float = 1.1
    by_conditions: str = "median"


@dataclass
class Node:
    """kind: leaf, product (independent columns; by 'data', 'workload' or 'constant'), sum (row clusters by `centres`), split (queries by `masks`), factorize (the first child models the columns `given`, each other one the rest for the rows of its box: `ranges` has for each of them an interval, open below and closed above, of each given column; NULL is below all). Children share columns in sum and split, part them in product."""

    kind: str
    columns: list[int]
    children: list[Node] = field(default_factory=list)
    by: str = ""
    centres: list[list[float]] = field(default_factory=list)
    fill: list[float] = field(default_factory=list)
    masks: list[list[int]] = field(default_factory=list)
    number: int = -1
    given: list[int] = field(default_factory=list)
    ranges: list[list[list[float]]] = field(default_factory=list)

    def in_box(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Which rows are in a factorize node's i-th box."""
        out = np.ones(len(rows), bool)
        for c, (lo, hi) in zip(self.given, self.ranges[i], strict=True):
            x = np.where(np.isfinite(rows[:, c]), rows[:, c], -np.inf)
            out &= ((x > lo) | (lo == -np.inf)) & (x <= hi)
        return out

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


def learn(rows: np.ndarray, boxes: np.ndarray, params: Params) -> Node:
    """rows (n, columns) with NaN for NULL; boxes (queries, columns, 2) with infinite bounds where there is none."""
    least = max(2, params.least_rows * len(rows))

    def bounded(queries: np.ndarray) -> np.ndarray:
        return np.isfinite(queries).any(axis=2)

    def grow(part: np.ndarray, columns: list[int], queries: np.ndarray, independent: bool) -> Node:
        if len(columns) == 1:
            return Node("leaf", columns)
        alone = lambda: Node("product", columns, [Node("leaf", [c]) for c in columns], "data")
        if len(part) <= least:
            return alone()
        some = part[:, columns]
        varied = [c for c in columns if len(np.unique(part[np.isfinite(part[:, c]), c])) > 1]
        if len(varied) < len(columns):
            children = [Node("leaf", [c]) for c in columns if c not in varied]
            return Node("product", columns, children + ([grow(part, varied, queries, independent)] if varied else []), "constant")
        used = bounded(queries)[:, columns] if len(queries) else np.zeros((0, len(columns)), bool)
        together = (used.T.astype(float) @ used) / max(len(used), 1)
        if not independent and params.by_columns == "poisson":
            groups = splits.poisson_groups(some)
            if len(groups) > 1:
                return Node("product", columns, [grow(part, [columns[i] for i in g], queries, True) for g in groups], "data")
        elif not independent:
            weights = dep.rdc(some)
            scale = (params.upper - params.lower) / (1 - np.exp(-params.steep))
            limit = np.exp(-params.steep * together) * scale + params.upper - scale
            if limit.mean() + limit.std() < params.upper:
                limit = np.full_like(limit, params.upper)
            groups = dep.components(len(columns), lambda i, j: weights[i, j] >= limit[i, j])
            if len(groups) > 1:
                return Node("product", columns, [grow(part, [columns[i] for i in g], queries, True) for g in groups], "data")
        if len(used):
            groups = dep.components(len(columns), lambda i, j: together[i, j] >= params.coaccess)
            if len(groups) > 1:
                return Node("product", columns, [grow(part, [columns[i] for i in g], queries, True) for g in groups], "workload")
            masks = (used * (1 << np.arange(len(columns)))).sum(1)
            own, n = np.unique(masks[masks > 0], return_counts=True)
            groups = list(zip(own.tolist(), n.tolist(), strict=True))
            if params.by_queries == "kmeans":
                sides, _ = splits.split_queries_by_means(groups, len(columns))
            else:
                sides, cut = split_queries(groups, least=params.cut)
                sides = sides if cut >= params.cut else []
            if len(sides) > 1:
                children = [grow(part, columns, queries[np.isin(masks, s)], False) for s in sides]
                return Node("split", columns, children, masks=sides)
        if params.strong <= 1:
            weights = dep.rdc(some)
            tied = max(dep.components(len(columns), lambda i, j: weights[i, j] >= params.strong), key=len)
            if 1 < len(tied) < len(columns):
                right = [columns[i] for i in tied]
                return factorize(part, [c for c in columns if c not in right], right, queries)
        centres = splits.row_centres(some, params.by_rows)
        full = dep.impute(some)
        label = dep.nearest(full, centres)
        if len(centres) < 2 or np.bincount(label, minlength=len(centres)).min() == 0:
            return alone()
        children = []
        for i in range(len(centres)):
            mine = part[label == i]
            low, high = np.nanmin(mine, 0), np.nanmax(mine, 0)
            near = ((queries[..., 0] <= high) & (queries[..., 1] >= low)).all(1) if len(queries) else np.zeros(0, bool)
            children.append(grow(mine, columns, queries[near], False))
        return Node("sum", columns, children, centres=centres.tolist(), fill=full.mean(0).tolist())

    def factorize(part: np.ndarray, left: list[int], right: list[int], queries: np.ndarray) -> Node:
        """Boxes of the left columns are cut until the right ones depend on none of them in a box, or its rows are few."""
        ranges: list[list[list[float]]] = []
        children = [grow(part, left, queries, False)]

        def cut(mine: np.ndarray, box: list[list[float]]) -> None:
            some = mine[:, [*left, *right]]
            own, scope = list(range(len(left))), list(range(len(left), some.shape[1]))
            where = None
            if len(mine) > 2 * least and max(splits.condition_strength(some, scope, own).values()) >= params.upper:
                where = splits.best_cut(some, scope, own, least=int(least)) if params.by_conditions == "grid" else splits.median_cut(some, scope, own)
            if where is not None:
                i, at = where
                x = np.where(np.isfinite(some[:, i]), some[:, i], -np.inf)
                low, high = mine[x <= at], mine[x > at]
                if len(low) and len(high):
                    for rows, side in ((low, [box[i][0], at]), (high, [at, box[i][1]])):
                        cut(rows, [side if j == i else b for j, b in enumerate(box)])
                    return
            ranges.append(box)
            children.append(grow(mine, right, queries, False))

        cut(part, [[-np.inf, np.inf] for _ in left])
        return Node("factorize", sorted([*left, *right]), children, given=left, ranges=ranges)

    root = grow(rows, list(range(rows.shape[1])), boxes, False)
    for i, node in enumerate(root.walk()):
        node.number = i
    return root


def check(root: Node) -> None:
    """Product children part their columns, sum and split children share them, a factorize node's first child has the given columns and all others the rest, with an interval of each given column; numbers are consecutive."""
    for i, node in enumerate(root.walk()):
        kids = [c.columns for c in node.children]
        if node.kind == "factorize":
            rest = sorted(set(node.columns) - set(node.given))
            fits = len(kids) > 1 and sorted(kids[0]) == sorted(node.given) and all(sorted(k) == rest for k in kids[1:]) and rest
            if node.number != i or not fits or len(node.ranges) != len(kids) - 1 or any(len(r) != len(node.given) for r in node.ranges):
                raise ValueError(f"node {i} is not valid")
            continue
        good = node.number == i and ((node.kind == "leaf" and len(node.columns) == 1 and not kids) or (node.kind == "product" and sorted(sum(kids, [])) == sorted(node.columns)) or (node.kind in ("sum", "split") and all(k == node.columns for k in kids) and len(kids) > 1))
        if not good:
            raise ValueError(f"node {i} is not valid")


def _route(node: Node, rows: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(leaf number, column, its rows) and, for each child of a sum, (child number, -1, its rows)."""
    if node.kind == "leaf":
        yield node.number, node.columns[0], at
        return
    if node.kind == "factorize":
        yield from _route(node.children[0], rows, at)
        for i, child in enumerate(node.children[1:]):
            own = at[node.in_box(i, rows[at])]
            yield child.number, -1, own
            yield from _route(child, rows, own)
        return
    label = None
    if node.kind == "sum":
        some = rows[np.ix_(at, node.columns)]
        label = dep.nearest(np.where(np.isfinite(some), some, node.fill), np.array(node.centres))
    for i, child in enumerate(node.children):
        own = at if label is None else at[label == i]
        if label is not None:
            yield child.number, -1, own
        yield from _route(child, rows, own)


@dataclass
class Grid:
    """Intervals of a column with many values: bin i is [edges[i], edges[i+1]], or edges[i] alone where `alone`. grain: distinct values to an interval, about."""

    edges: list[float]
    alone: list[bool]
    grain: float

    def place(self, v: np.ndarray) -> np.ndarray:
        """The bin of each value. Even numbers are intervals, odd ones the value at their lower edge alone."""
        edges = np.array(self.edges)
        i = np.clip(np.searchsorted(edges, v, "right") - 1, 0, max(len(edges) - 2, 0))
        return 2 * i + (np.array(self.alone)[i] & (v == edges[i]))

    def bin(self, place: int) -> tuple[float, float]:
        i = place // 2
        return (self.edges[i], self.edges[i]) if place % 2 else (self.edges[i], self.edges[min(i + 1, len(self.edges) - 1)])


def grids(df: DataFrame, columns: Sequence[str], max_bins: int) -> tuple[int, dict[str, Grid]]:
    """The rows of a table, and the grids of its columns of more than max_bins distinct values: one pass for the counts, one for the quantiles if any."""
    first = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(F.col(c).cast("double"), 0.02).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    many = [c for i, c in enumerate(columns) if first[f"d{i}"] > max_bins]
    out = {}
    if many:
        shares = [i / max_bins for i in range(max_bins + 1)]
        cuts = df.select(*[F.col(c).cast("double").alias(c) for c in many]).approxQuantile(many, shares, 0.25 / max_bins)
        for c, found in zip(many, cuts, strict=True):
            edges, times = np.unique(found, return_counts=True)
            out[c] = Grid(edges.tolist(), (times > 1).tolist(), max(1.0, first[f"d{columns.index(c)}"] / max(len(edges) - 1, 1)))
    return first.n, out


def tallies(root: Node, rows: np.ndarray, columns: Sequence[str], grid: dict[str, Grid], base: int = 0, only: set[int] | None = None) -> list[tuple]:
    """(node, col, v, n) of some rows, as `count` has them; node numbers from base on; only: of these nodes. v is the bin's number where the column has a grid."""
    out: list[tuple] = []
    for number, column, at in _route(root, rows, np.arange(len(rows))):
        if only is not None and number not in only:
            continue
        number += base
        if column >= 0:
            v, name = rows[at, column], columns[column]
            known = v[np.isfinite(v)]
            known, n = np.unique(grid[name].place(known) if name in grid else known, return_counts=True)
            out += [(number, name, float(x), k) for x, k in zip(known.tolist(), n.tolist(), strict=True)]
            if missing := int((~np.isfinite(v)).sum()):
                out.append((number, name, None, missing))
        elif len(at):
            out.append((number, "", None, len(at)))
            for c, name in enumerate(columns):
                v = rows[at, c]
                if np.isfinite(v).any():
                    out += [(number, f"<{name}", float(np.nanmin(v)), 0), (number, f">{name}", float(np.nanmax(v)), 0)]
    return out


TALLIES = "node int, col string, v double, n long"


def tally_batch(out: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b), pa.array(c, pa.float64()), pa.array(d, pa.int64())], ["node", "col", "v", "n"])


def count(df: DataFrame, columns: Sequence[str], root: Node, grid: dict[str, Grid] | None = None, only: set[int] | None = None) -> DataFrame:
    """(node, col, v, n) over all rows: value counts of leaves; for children of sums, rows as col '' and the box as '<c' and '>c' with the bound in v."""
    grid = grid or {}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in dep.batches_to_rows(batches, columns):
            if out := tallies(root, rows, columns, grid, only=only):
                yield tally_batch(out)

    return added_up(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(task, TALLIES))


def added_up(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tallies of all tasks, or of old and new rows, as one; by: columns that tell trees apart."""
    box = F.substring("col", 1, 1).isin("<", ">")
    key = F.when(~box, F.col("v"))
    out = rows.groupBy(*by, "node", "col", key.alias("k")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.select(*by, "node", "col", F.when(F.col("col").startswith("<"), F.col("low")).when(F.col("col").startswith(">"), F.col("high")).otherwise(F.col("k")).alias("v"), "n")


class Model:
    """A fitted tree: the structure, each leaf's bins, each sum child's weight and box. Its size follows the tree and the distinct values, not the rows."""

    def __init__(self, columns: Sequence[str], root: Node, rows: int, bins: dict, weights: dict, bounds: dict, grid: dict[str, Grid] | None = None):
        self.columns, self.root, self.rows, self.bins, self.weights, self.bounds, self.grid = list(columns), root, rows, bins, weights, bounds, grid or {}

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], boxes: np.ndarray, params: Params | None = None, root: Node | None = None) -> Model:
        params = params or Params()
        total, grid = grids(df, columns, params.max_bins)
        if root is None:
            numbers = [F.col(c).cast("double").alias(c) for c in columns]
            share = min(1.0, 2.0 * params.sample / max(total, 1))
            sample = df.select(*numbers) if share >= 1 else df.select(*numbers).sample(False, share, 17)
            # In random order, as a bare limit takes the first partitions' rows.
            some = sample.orderBy(F.rand(18)).limit(params.sample).collect()
            rows = np.array([tuple(np.nan if x is None else x for x in r) for r in some], float).reshape(-1, len(columns))
            root = learn(rows, boxes, params) if len(rows) else Node("product", list(range(len(columns))), [Node("leaf", [i]) for i in range(len(columns))], "data")
            for i, node in enumerate(root.walk()):
                node.number = i
        check(root)
        return cls.from_counts(columns, root, total, count(df, columns, root, grid), grid)

    @classmethod
    def fit_binary(cls, df: DataFrame, columns: Sequence[str], params: Params | None = None) -> Model:
        """A tree of columns of 0 and 1, without a workload; other values raise, NULLs do not count."""
        odd = df.select(*[F.count_if(~F.col(c).cast("double").isin(0.0, 1.0)).alias(c) for c in columns]).first()
        if wrong := [c for c in columns if odd[c]]:
            raise ValueError(f"not binary: {wrong}")
        return cls.fit(df, columns, np.zeros((0, len(columns), 2)), params)

    @classmethod
    def from_counts(cls, columns: Sequence[str], root: Node, total: int, counts: DataFrame, grid: dict[str, Grid] | None = None) -> Model:
        """What comes to the driver is bounded by the tree's leaves times their bins: a column has a grid, or at most about max_bins values."""
        grid = grid or {}
        own = counts.where("col <> '' and substring(col, 1, 1) not in ('<', '>')")
        points = own.where(~F.col("col").isin(list(grid))) if grid else own
        domain = points.where("v is not null").select("col", "v").distinct()
        bins: dict[int, dict] = {}
        for r in leaves.histogram(points, domain, ["node"]).orderBy("node", "lo").collect():
            b = bins.setdefault(r.node, {"lo": [], "hi": [], "pdf": [], "non_null": r.non_null})
            b["lo"].append(r.lo)
            b["hi"].append(r.hi)
            b["pdf"].append(r.pdf)
        if grid:
            leaf: dict[tuple, list] = {}
            for r in own.where(F.col("col").isin(list(grid))).collect():
                leaf.setdefault((r.node, r.col), []).append((r.v, r.n))
            for (node, col), some in leaf.items():
                known = sorted((*grid[col].bin(int(v)), n) for v, n in some if v is not None)
                whole = sum(n for *_, n in known)
                if known:
                    bins[node] = {"lo": [a for a, *_ in known], "hi": [z for _, z, _ in known], "pdf": [n / whole for *_, n in known], "non_null": whole / sum(n for _, n in some), "grain": grid[col].grain}
        weights, bounds = {}, {}
        for r in counts.where("col = '' or substring(col, 1, 1) in ('<', '>')").collect():
            if r.col == "":
                weights[r.node] = r.n
            else:
                bounds.setdefault(r.node, {}).setdefault(r.col[1:], [0.0, 0.0])[r.col[0] == ">"] = r.v
        return cls(columns, root, total, bins, weights, bounds, grid)

    @staticmethod
    def leaf_probability(b: dict, lo: float, hi: float) -> float:
        """Of the bins that the closed range touches, whole; of intervals the share that it covers, of one value the share of an even value."""
        a, z, pdf = np.asarray(b["lo"]), np.asarray(b["hi"]), np.asarray(b["pdf"])
        touched = (a <= hi) & (z >= lo)
        if "grain" in b:
            wide = z > a
            cover = np.clip((np.minimum(hi, z) - np.maximum(lo, a)) / np.where(wide, z - a, 1.0), 0.0, 1.0) if hi > lo else np.full(len(a), 1.0 / b["grain"])
            pdf = pdf * np.where(wide, cover, 1.0)
        return float(pdf[touched].sum()) * b["non_null"]

    def probability(self, lo: np.ndarray, hi: np.ndarray) -> float:
        """Of one box. Products skip parts that the query leaves free; sums take 0 for a box that is missed and 1 for one that is covered; splits ask one child; factorize nodes add up, over their boxes, the given columns' probability inside box and query times the others' in that box."""
        asked = [bool(np.isfinite(a) or np.isfinite(b)) for a, b in zip(lo, hi, strict=True)]

        def factorized(node: Node, asked: list[bool], lo: np.ndarray, hi: np.ndarray) -> float:
            left, rights = node.children[0], node.children[1:]
            if not any(asked[c] for c in rights[0].columns):
                return value(left, asked, lo, hi)
            total = sum(self.weights.get(c.number, 0) for c in rights)
            out = 0.0
            for child, box in zip(rights, node.ranges, strict=True):
                if not self.weights.get(child.number, 0):
                    continue
                if any(asked[c] for c in node.given):
                    low, high, also = lo.copy(), hi.copy(), list(asked)
                    for c, (a, z) in zip(node.given, box, strict=True):
                        if a > -np.inf or z < np.inf:
                            low[c], high[c], also[c] = max(lo[c], np.nextafter(a, np.inf)), min(hi[c], z), True
                    p = 0.0 if any(low[c] > high[c] for c in node.given) else value(left, also, low, high)
                else:
                    p = self.weights[child.number] / total
                if p:
                    out += p * value(child, asked, lo, hi)
            return out

        def value(node: Node, asked: list[bool], lo: np.ndarray, hi: np.ndarray) -> float:
            if not any(asked[c] for c in node.columns):
                return 1.0
            if node.kind == "leaf":
                b = self.bins.get(node.number)
                if b is None:
                    return 0.0
                return self.leaf_probability(b, lo[node.columns[0]], hi[node.columns[0]])
            if node.kind == "factorize":
                return factorized(node, asked, lo, hi)
            if node.kind == "product":
                out = 1.0
                for child in node.children:
                    out *= value(child, asked, lo, hi)
                return out
            if node.kind == "split":
                mask = sum(1 << i for i, c in enumerate(node.columns) if asked[c])
                score = [(max((m & mask).bit_count() for m in own), (int(np.bitwise_or.reduce(own)) & mask).bit_count()) for own in node.masks]
                return value(node.children[max(range(len(score)), key=lambda i: (score[i], -i))], asked, lo, hi)
            total = sum(self.weights.get(c.number, 0) for c in node.children)
            out = 0.0
            for child in node.children:
                w = self.weights.get(child.number, 0)
                box = self.bounds.get(child.number, {})
                used = [c for c in node.columns if asked[c]]
                sides = [box.get(self.columns[c]) for c in used]
                if not w or any(s is None or lo[c] > s[1] or hi[c] < s[0] for c, s in zip(used, sides, strict=True)):
                    continue
                out += w / total * value(child, asked, lo, hi)
            return out

        return min(1.0, value(self.root, asked, lo, hi))

    def expectation(self, column: str, lo: np.ndarray, hi: np.ndarray) -> float:
        """E[1{box} * x] of a column, by its value's share of each bin: the box narrowed to the bin, times the bin's middle."""
        c = self.columns.index(column)
        of_leaf = lambda n: zip(self.bins[n.number]["lo"], self.bins[n.number]["hi"], self.bins[n.number]["pdf"], strict=True)
        cut = column in self.grid
        values = sorted({(a, b) for n in self.root.walk() if n.kind == "leaf" and n.columns == [c] and n.number in self.bins for a, b, p in of_leaf(n) if a == b or (cut and p)})
        out = 0.0
        for a, b in values:
            if cut and a < b:  # without its edges, which may be values alone
                a, b = max(np.nextafter(a, np.inf), lo[c]), min(np.nextafter(b, -np.inf), hi[c])
            if lo[c] <= a and b <= hi[c] and a <= b:
                low, high = lo.copy(), hi.copy()
                low[c], high[c] = a, b
                out += (a + b) / 2 * self.probability(low, high)
        return out

    def marginal(self, columns: Sequence[str]) -> Model:
        """The model of some columns only: other columns are never asked, so their leaves are dropped."""
        keep = {self.columns.index(c) for c in columns}
        weights, bounds = dict(self.weights), dict(self.bounds)

        def cut(node: Node) -> Node | None:
            own = [c for c in node.columns if c in keep]
            if node.kind == "factorize":  # the given columns stay whole where others hang on them
                rest = [cut(c) for c in node.children[1:]]
                if rest[0] is not None:
                    return replace(node, children=[node.children[0], *rest])
                if (left := cut(node.children[0])) is not None:  # takes the node's place, with its rows and bounds
                    for own in (weights, bounds):
                        if node.number in own:
                            own[left.number] = own[node.number]
                return left
            kids = [k for c in node.children if (k := cut(c)) is not None]
            if not own:
                return None
            return replace(node, columns=own if node.kind in ("leaf", "product") else node.columns, children=kids)

        return Model(self.columns, cut(self.root), self.rows, self.bins, weights, bounds, self.grid)

    def most_probable(self, evidence: dict[str, float]) -> dict[str, float]:
        """Best values of the free columns along the best path, evidence kept."""
        fixed = {self.columns.index(c): v for c, v in evidence.items()}

        def best(node: Node) -> tuple[float, dict[int, float]]:
            if node.kind == "leaf":
                c, b = node.columns[0], self.bins.get(node.number, {"lo": [0.0], "hi": [0.0], "pdf": [0.0]})
                if c in fixed:
                    return sum(p for a, z, p in zip(b["lo"], b["hi"], b["pdf"], strict=True) if a <= fixed[c] <= z), {c: fixed[c]}
                k = int(np.argmax(b["pdf"]))
                return b["pdf"][k], {c: (b["lo"][k] + b["hi"][k]) / 2}
            if node.kind == "factorize":
                p, own = best(node.children[0])
                point = np.full((1, len(self.columns)), np.nan)
                point[0, list(own)] = list(own.values())
                i = max(range(len(node.ranges)), key=lambda i: (bool(node.in_box(i, point)[0]), -i))
                q, rest = best(node.children[1 + i])
                return p * q, {**own, **rest}
            found = [best(c) for c in node.children]
            if node.kind == "product":
                return float(np.prod([p for p, _ in found])), {k: v for _, d in found for k, v in d.items()}
            if node.kind == "split":
                return found[0]
            total = sum(self.weights.get(c.number, 0) for c in node.children) or 1
            return max(((self.weights.get(c.number, 0) / total * p, d) for c, (p, d) in zip(node.children, found, strict=True)), key=lambda x: x[0])

        return {self.columns[c]: v for c, v in sorted(best(self.root)[1].items())}

    def draw(self, n: int, seed: int = 0) -> np.ndarray:
        """Rows drawn from the model, NaN for NULL."""
        rng = np.random.default_rng(seed)
        out = np.full((n, len(self.columns)), np.nan)

        def fill(node: Node, at: np.ndarray) -> None:
            if node.kind == "leaf":
                if b := self.bins.get(node.number):
                    p = np.array(b["pdf"])
                    k = rng.choice(len(p), len(at), p=p / p.sum())
                    a, z = np.array(b["lo"])[k], np.array(b["hi"])[k]
                    v = a + (z - a) * (rng.random(len(k)) if "grain" in b else 0.5)
                    out[at, node.columns[0]] = np.where(rng.random(len(at)) < b["non_null"], v, np.nan)
            elif node.kind == "product":
                for c in node.children:
                    fill(c, at)
            elif node.kind == "split":
                fill(node.children[0], at)
            elif node.kind == "factorize":
                fill(node.children[0], at)
                for i, c in enumerate(node.children[1:]):
                    fill(c, at[node.in_box(i, out[at])])
            else:
                w = np.array([self.weights.get(c.number, 0) for c in node.children], float)
                side = rng.choice(len(w), len(at), p=w / w.sum())
                for i, c in enumerate(node.children):
                    fill(c, at[side == i])

        fill(self.root, np.arange(n))
        return out

    def estimate(self, workload: DataFrame) -> DataFrame:
        """(qid, p, estimate) of a long-form workload; the estimate is at least 1. The model goes to the tasks, queries are spread over them."""
        columns, model = self.columns, self

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for bounds in batch.column("bounds").to_pylist():
                    lo, hi = np.full(len(columns), -np.inf), np.full(len(columns), np.inf)
                    for b in bounds:
                        i = columns.index(b["col"])
                        lo[i], hi[i] = max(lo[i], b["lo"]), min(hi[i], b["hi"])
                    out.append(0.0 if (lo > hi).any() else model.probability(lo, hi))
                yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array(out)], ["qid", "p"])

        grouped = workload.groupBy("qid").agg(F.collect_list(F.struct("col", "lo", "hi")).alias("bounds"))
        return grouped.mapInArrow(task, "qid long, p double").select("qid", "p", F.greatest(F.lit(1.0), F.rint(F.col("p") * self.rows)).alias("estimate"))

    def statistics(self) -> dict[str, int]:
        nodes = list(self.root.walk())
        return {k: sum(n.kind == k for n in nodes) for k in ("sum", "product", "split", "factorize", "leaf")} | {"edges": len(nodes) - 1, "bins": sum(len(b["pdf"]) for b in self.bins.values())}

    def save(self, spark: SparkSession, path: str) -> None:
        nodes = [(n.number, n.kind, n.by, n.columns, [c.number for c in n.children], json.dumps([n.centres, n.fill, n.masks, n.given, n.ranges]), self.weights.get(n.number), json.dumps(self.bounds.get(n.number))) for n in self.root.walk()]
        spark.createDataFrame(nodes, "node int, kind string, by string, columns array<int>, children array<int>, routing string, weight long, box string").coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [(k, i, float(a), float(z), float(p), b["non_null"], b.get("grain")) for k, b in self.bins.items() for i, (a, z, p) in enumerate(zip(b["lo"], b["hi"], b["pdf"], strict=True))]
        spark.createDataFrame(rows, "node int, bin int, lo double, hi double, pdf double, non_null double, grain double").coalesce(1).write.mode("overwrite").parquet(f"{path}/leaf_bins")
        spark.createDataFrame([(self.columns, self.rows, json.dumps({c: [g.edges, g.alone, g.grain] for c, g in self.grid.items()}))], "columns array<string>, rows long, grid string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        meta = spark.read.parquet(f"{path}/meta").first()
        rows = {r.node: r for r in spark.read.parquet(f"{path}/nodes").collect()}

        def build(i: int) -> Node:
            r = rows[i]
            centres, fill, masks, given, ranges = json.loads(r.routing)
            return Node(r.kind, list(r.columns), [build(c) for c in r.children], r.by, centres, fill, masks, i, given, ranges)

        bins: dict[int, dict] = {}
        for r in spark.read.parquet(f"{path}/leaf_bins").orderBy("node", "bin").collect():
            b = bins.setdefault(r.node, {"lo": [], "hi": [], "pdf": [], "non_null": r.non_null, **({"grain": r.grain} if r.grain else {})})
            for k in ("lo", "hi", "pdf"):
                b[k].append(r[k])
        bounds = {i: json.loads(r.box) for i, r in rows.items() if r.box != "null"}
        return cls(meta.columns, build(0), meta.rows, bins, {i: r.weight for i, r in rows.items() if r.weight is not None}, bounds, {c: Grid(*g) for c, g in json.loads(meta.grid).items()})

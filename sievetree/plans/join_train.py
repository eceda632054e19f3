"""Join estimates from trained models: statistics and one tree for each cell of key bins of each table, built once, saved, and asked
without a look at base rows.

A join key belongs to a class of keys that equal each other in some join; the class has one range of values, cut into bins of one width,
and special values, the keys of the largest joins, with bins of their own. The rows of a table with the same bins are a cell. A cell
has its rows, its distinct keys, and a model of the columns that queries filter: a tree learned from a bounded sample of the cell and
counted over all its rows (`learned`), leaves taken as independent (`independent`), or the sample itself (`sampled`).

`fit` makes four passes over a table whatever the number of cells: key ranges, cell statistics, samples (a bounded number of rows a cell
leaves each task), and counts (added up in each task before the exchange); no cell's rows come together anywhere. A table of at most
`max_cells` cells is held by the driver, as its files show, and estimates are arithmetic on it. One of more cells stays a table (`CellTable`),
a row for each cell with its model; estimates of a model that has one are the same arithmetic as joins and sums of cells.

Estimate of an acyclic equi-join, cells of the last table at the root: a cell keeps n*p rows and ndv*(1-(1-p)^(n/ndv)) keys; each child
multiplies it by its rows a key, and once, by the smallest share of its keys that a child has, if below 1; on special keys
those shares count sorted ascending, the k-th to the power 1/k. Cells whose bin a child lacks fall away. A child is projected on its
parent's key: rows add up, distinct keys as w*(1-prod(1-ndv/w)) with w keys in the bin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import leaves
from ..operators import dependence as dep
from . import join_model as jm
from .tree import TALLIES, Grid, Model, Node, Params, added_up, grids, learn, tallies, tally_batch


@dataclass(frozen=True)
class Setting:
    """width of a key bin, number of special values"""

    width: float
    special: int


#: The settings of two public workloads.
SETTINGS = {"job": Setting(1_500_000, 5000), "stats": Setting(60_000, 100)}


@dataclass
class Query:
    """tables in order, the last at the root unless another root is asked for; joins: (table, key, table, key); boxes: table -> column -> (lo, hi), closed."""

    tables: list[str]
    joins: list[tuple[str, str, str, str]]
    boxes: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)


@dataclass
class JoinTree:
    """A table of a join, the keys that its children hang on, and its own key to its parent."""

    table: str
    key: str | None = None
    children: list[tuple[str, JoinTree]] = field(default_factory=list)


def key_classes(joins: Sequence[tuple[str, str, str, str]]) -> dict[tuple[str, str], int]:
    """(table, key) -> number of its class of equal keys, numbered in order of the first key."""
    keys = sorted({k for a, x, b, y in joins for k in ((a, x), (b, y))})
    own = {k: k for k in keys}

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    for a, x, b, y in joins:
        first, last = sorted((root((a, x)), root((b, y))))
        own[last] = first
    number = {r: i for i, r in enumerate(k for k in keys if own[k] == k)}
    return {k: number[root(k)] for k in keys}


def orient(query: Query, root: str | None = None) -> JoinTree:
    """The join as a tree from the root down."""
    root = root or query.tables[-1]
    seen = {root}

    def grow(table: str, key: str | None) -> JoinTree:
        node = JoinTree(table, key)
        for a, x, b, y in query.joins:
            for (me, mine), (other, its) in (((a, x), (b, y)), ((b, y), (a, x))):
                if me == table and other not in seen:
                    seen.add(other)
                    node.children.append((mine, grow(other, its)))
        return node

    tree = grow(root, None)
    if seen != set(query.tables) or len(query.joins) != len(query.tables) - 1:
        raise ValueError("the join must be a tree of its tables")
    return tree


def best_root(query: Query, cells: dict[str, int]) -> str:
    """The table with the most classes of keys among its joins, then the most cells, then the first."""
    classes = key_classes(query.joins)
    kinds = {t: {classes[k] for a, x, b, y in query.joins for k in ((a, x), (b, y)) if k[0] == t} for t in query.tables}
    return max(query.tables, key=lambda t: (len(kinds[t]), cells.get(t, 0), -query.tables.index(t)))


def compressed(tree: JoinTree) -> JoinTree:
    """Chains on one key hoisted: where a child passes its own key on to a grandchild, the grandchild hangs on the parent's key instead."""
    children: list[tuple[str, JoinTree]] = []
    for key, child in tree.children:
        child = compressed(child)
        kept = [(k, g) for k, g in child.children if k != child.key]
        children.append((key, JoinTree(child.table, child.key, kept)))
        children += [(key, g) for k, g in child.children if k == child.key]
    return JoinTree(tree.table, tree.key, children)


class Sampled:
    """A cell's sample as its model."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def probability(self, lo: np.ndarray, hi: np.ndarray) -> float:
        asked = np.isfinite(lo) | np.isfinite(hi)
        inside = (self.rows[:, asked] >= lo[asked]) & (self.rows[:, asked] <= hi[asked])
        return float(inside.all(1).mean()) if len(self.rows) else 0.0


@dataclass
class Cells:
    """One table: key columns, filter columns, and by cell its bins, rows, distinct keys and model."""

    keys: list[str]
    columns: list[str]
    bins: np.ndarray
    n: np.ndarray
    ndv: np.ndarray
    models: list

    def selectivity(self, box: dict[str, tuple[float, float]], some: np.ndarray) -> np.ndarray:
        """Of the cells numbered in some: the model's probability, at most 1; 1 without a filter, 0 for an empty range."""
        lo, hi = _box(self.columns, box)
        if (lo > hi).any():
            return np.zeros(len(some))
        if not np.isfinite(np.r_[lo, hi]).any():
            return np.ones(len(some))
        return np.array([min(1.0, self.models[i].probability(lo, hi)) for i in some.tolist()])


def _box(columns: list[str], box: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.full(len(columns), -np.inf), np.full(len(columns), np.inf)
    for c, (a, z) in box.items():
        i = columns.index(c)
        lo[i], hi[i] = max(lo[i], a), min(hi[i], z)
    return lo, hi


@dataclass
class CellTable:
    """One table of more cells than the driver holds: frame has bin_<key>, n, ndv_<key> and the model of each cell: `root` with what was counted for it (`points`: smoothed bins; `places`: bins of grids; `extent`: weights and bounds), or its `rows`, a sample."""

    keys: list[str]
    columns: list[str]
    grid: dict[str, Grid]
    frame: DataFrame

    def filtered(self, box: dict[str, tuple[float, float]]) -> DataFrame:
        """(bin_<key>, n, ndv_<key>, p): p as `Cells.selectivity` has it."""
        names = [*[f"bin_{k}" for k in self.keys], "n", *[f"ndv_{k}" for k in self.keys]]
        lo, hi = _box(self.columns, box)
        if (lo > hi).any() or not np.isfinite(np.r_[lo, hi]).any():
            return self.frame.select(*names, F.lit(0.0 if (lo > hi).any() else 1.0).alias("p"))
        columns, grid = self.columns, self.grid

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = [min(1.0, _cell_model(columns, grid, *row).probability(lo, hi)) for row in zip(*[batch.column(c).to_pylist() for c in _MODEL], strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(p, pa.float64())], [*names, "p"])

        kinds = {f.name: f.dataType.simpleString() for f in self.frame.schema}
        return self.frame.select(*names, *_MODEL).mapInArrow(task, ", ".join(f"{c} {kinds[c]}" for c in names) + ", p double")


#: Columns of a cell's model in a CellTable.
_MODEL = {
    "root": "string",
    "points": "array<struct<node:int,lo:double,hi:double,pdf:double,non_null:double>>",
    "places": "array<struct<node:int,col:string,v:double,n:bigint>>",
    "extent": "array<struct<node:int,col:string,v:double,n:bigint>>",
    "rows": "array<array<double>>",
}


def _cell_model(columns: list[str], grid: dict[str, Grid], root: str | None, points, places, extent, rows):
    """The model of a cell; numbers as `Model.from_counts` has them."""
    if root is None:
        return Sampled(np.array([[np.nan if x is None else x for x in r] for r in rows or []], float).reshape(-1, len(columns)))
    bins: dict[int, dict] = {}
    for x in sorted(points or [], key=lambda x: (x["node"], x["lo"])):
        b = bins.setdefault(x["node"], {"lo": [], "hi": [], "pdf": [], "non_null": x["non_null"]})
        for c in ("lo", "hi", "pdf"):
            b[c].append(x[c])
    leaf: dict[tuple, list] = {}
    for x in places or []:
        leaf.setdefault((x["node"], x["col"]), []).append((x["v"], x["n"]))
    for (node, col), some in leaf.items():
        known = sorted((*grid[col].bin(int(v)), n) for v, n in some if v is not None)
        whole = sum(n for *_, n in known)
        if known:
            bins[node] = {"lo": [a for a, *_ in known], "hi": [z for _, z, _ in known], "pdf": [n / whole for *_, n in known], "non_null": whole / sum(n for _, n in some), "grain": grid[col].grain}
    weights, bounds = {}, {}
    for x in extent or []:
        if x["col"] == "":
            weights[x["node"]] = x["n"]
        else:
            bounds.setdefault(x["node"], {}).setdefault(x["col"][1:], [0.0, 0.0])[x["col"][0] == ">"] = x["v"]
    return Model(columns, _node_of(json.loads(root)), 0, bins, weights, bounds, grid)


def _node_text(node: Node) -> dict:
    return asdict(node)


def _node_of(d: dict) -> Node:
    return Node(**{**d, "children": [_node_of(c) for c in d["children"]]})


def _stars(columns: int) -> Node:
    root = Node("product", list(range(columns)), [Node("leaf", [i]) for i in range(columns)], "data") if columns > 1 else Node("leaf", [0])
    for i, node in enumerate(root.walk()):
        node.number = i
    return root


class JoinModel:
    def __init__(self, tables: dict[str, Cells | CellTable], classes: dict[tuple[str, str], int], ranges: dict[int, tuple[float, float]], width: float):
        self.tables, self.classes, self.ranges, self.width = tables, classes, ranges, width

    # Training

    @classmethod
    def fit(cls, tables: dict[str, DataFrame], joins: Sequence[tuple[str, str, str, str]], columns: dict[str, list[str]], setting: Setting, boxes: dict[str, np.ndarray] | None = None, by: str = "learned", params: Params | None = None, sample: int = 1000, max_cells: int = 100_000) -> JoinModel:
        """columns: the numeric columns of each table that queries filter; boxes: the workload's queries of each table, (queries, columns, 2). Rows with a NULL key are in no join and dropped."""
        if by not in ("learned", "independent", "sampled"):
            raise ValueError(by)
        classes = key_classes(joins)
        keys = {t: [k for (u, k) in classes if u == t] for t in tables}
        ranges: dict[int, list[float]] = {}
        for t, df in tables.items():
            found = df.agg(*[f(F.col(k).cast("double")).alias(f"{name}{i}") for i, k in enumerate(keys[t]) for name, f in (("a", F.min), ("z", F.max))]).first()
            for i, k in enumerate(keys[t]):
                if found[f"a{i}"] is not None:
                    r = ranges.setdefault(classes[t, k], [found[f"a{i}"], found[f"z{i}"]])
                    r[:] = min(r[0], found[f"a{i}"]), max(r[1], found[f"z{i}"])
        specials = {}
        for c in sorted(set(classes.values())) if setting.special else ():
            # The ranks of a bounded top list.
            top = jm.special_values([(tables[t], k) for (t, k), own in classes.items() if own == c], setting.special).collect()
            specials[c] = tables[next(iter(tables))].sparkSession.createDataFrame([(r.v, i) for i, r in enumerate(top, 1)], "v long, rank long")
        out = {}
        for t, df in tables.items():
            own = (boxes or {}).get(t, np.zeros((0, len(columns[t]), 2)))
            out[t] = cls._cells(df, keys[t], [classes[t, k] for k in keys[t]], ranges, specials, columns[t], setting.width, own, by, params or Params(), sample, max_cells)
        return cls(out, classes, {c: (a, z) for c, (a, z) in ranges.items()}, setting.width)

    @staticmethod
    def _cells(df, keys, classes, ranges, specials, columns, width, boxes, by, params, sample, max_cells) -> Cells | CellTable:
        spark = df.sparkSession
        place = {k: (ranges.get(c, (0.0, 0.0))[0], width) for k, c in zip(keys, classes, strict=True)}
        special = {k: specials[c] for k, c in zip(keys, classes, strict=True) if c in specials}
        stats = jm.partition_stats(df, place, special=special or None).limit(max_cells + 1).collect()
        if len(stats) > max_cells:
            return JoinModel._table(df, list(keys), place, special, list(columns), boxes, by, params, sample)
        names = [f"bin_{k}" for k in keys]
        stats.sort(key=lambda r: [r[b] for b in names])
        bins = np.array([[r[b] for b in names] for r in stats], np.int64).reshape(len(stats), len(keys))
        n, ndv = np.array([r.n for r in stats], float), np.array([[r[f"ndv_{k}"] for k in keys] for r in stats], float).reshape(len(stats), len(keys))
        cells = Cells(list(keys), list(columns), bins, n, ndv, [None] * len(stats))
        if not len(stats) or not columns:
            return cells
        rows = df.na.drop(subset=list(keys)).select(*{*keys, *columns})
        for k, (low, w) in place.items():
            rows = jm.special_bin(rows, k, special[k], w, low) if k in special else rows.withColumn(f"bin_{k}", jm.key_bin(F.col(k), w, low))
        numbers = spark.createDataFrame([(*b, i) for i, b in enumerate(bins.tolist())], ", ".join(f"{b} long" for b in names) + ", cell int")
        # As many rows as the model has cells, at most max_cells.
        rows = rows.join(F.broadcast(numbers), names).select("cell", *[F.col(c).cast("double").alias(c) for c in columns])
        roots: dict[int, Node] = {}
        if by != "independent":
            turn = Window.partitionBy("cell").orderBy("turn")
            some = rows.withColumn("turn", F.rand(17)).withColumn("k", F.row_number().over(turn)).where(F.col("k") <= sample).select("cell", *columns)
            if by == "sampled":
                found: dict[int, list] = {}
                for r in some.collect():  # sample rows a cell at most: the model itself
                    found.setdefault(r.cell, []).append([np.nan if x is None else x for x in r[1:]])
                cells.models = [Sampled(np.array(found.get(i, []), float).reshape(-1, len(columns))) for i in range(len(stats))]
                return cells

            def learned(table: pa.Table) -> pa.Table:
                values = np.column_stack([table.column(c).to_pandas().to_numpy(float) for c in columns])
                return pa.table({"cell": table.column("cell").slice(0, 1), "root": pa.array([json.dumps(_node_text(learn(values, boxes, params)))])})

            roots = {r.cell: _node_of(json.loads(r.root)) for r in some.groupBy("cell").applyInArrow(learned, "cell int, root string").collect()}
        roots = {i: roots.get(i) or _stars(len(columns)) for i in range(len(stats))}
        _, grid = grids(rows, columns, params.max_bins)
        first, base = {}, 0
        for i, root in roots.items():
            first[i] = base
            base += sum(1 for _ in root.walk())
        shared = spark.sparkContext.broadcast((roots, first, grid))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            roots, first, grid = shared.value
            for batch in batches:
                own = batch.column("cell").to_numpy(zero_copy_only=False)
                order = np.argsort(own, kind="stable")
                values = next(iter(dep.batches_to_rows(iter([batch]), columns)), np.zeros((0, len(columns))))
                edges = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1], True]) if len(own) else []
                out: list[tuple] = []
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    i = int(own[order[a]])
                    out += tallies(roots[i], values[order[a:z]], columns, grid, first[i])
                if out:
                    yield tally_batch(out)

        counts = added_up(rows.mapInArrow(task, TALLIES)).persist(StorageLevel.DISK_ONLY)  # read several times, the rows once
        whole = Model.from_counts(columns, Node("leaf", [0]), 0, counts, grid)
        counts.unpersist()
        for i, root in roots.items():
            of = [node.number for node in root.walk()]
            mine = lambda d: {k: d[k + first[i]] for k in of if k + first[i] in d}  # noqa: B023, E731
            cells.models[i] = Model(columns, root, int(n[i]), mine(whole.bins), mine(whole.weights), mine(whole.bounds), grid)
        return cells

    @staticmethod
    def _table(df, keys, place, special, columns, boxes, by, params, sample) -> CellTable:
        """The cells of one table where they stay a table: the passes of `_cells`, keyed by bins."""
        names = [f"bin_{k}" for k in keys]
        whole = jm.partition_stats(df, place, special=special or None).select(*names, F.col("n").cast("double").alias("n"), *[F.col(f"ndv_{k}").cast("double").alias(f"ndv_{k}") for k in keys])
        rows = df.na.drop(subset=keys).select(*{*keys, *columns})
        for k, (low, w) in place.items():
            rows = jm.special_bin(rows, k, special[k], w, low) if k in special else rows.withColumn(f"bin_{k}", jm.key_bin(F.col(k), w, low))
        rows = rows.select(*names, *[F.col(c).cast("double").alias(c) for c in columns])
        grid: dict[str, Grid] = {}

        def joined(parts: DataFrame, label: str, value: Column) -> None:
            nonlocal whole
            whole = whole.join(parts.groupBy(*names).agg(F.collect_list(value).alias(label)).hint("merge"), names, "left")

        if columns and by != "independent":
            turn = Window.partitionBy(*names).orderBy("turn")
            some = rows.withColumn("turn", F.rand(17)).withColumn("k", F.row_number().over(turn)).where(F.col("k") <= sample).select(*names, *columns)
        if columns and by == "sampled":
            joined(some, "rows", F.array(*columns))
        elif columns:
            _, grid = grids(rows, columns, params.max_bins)
            # One column leaves nothing to learn.
            plain = by == "independent" or len(columns) == 1
            stars = _stars(len(columns))
            text = json.dumps(_node_text(stars))
            if plain and not grid:
                number = F.create_map(*[F.lit(x) for node in stars.walk() if node.kind == "leaf" for x in (columns[node.columns[0]], node.number)])
                counts = leaves.value_counts(rows, columns, names).select(*names, number[F.col("col")].alias("node"), "col", "v", "n")
            else:
                if not plain:

                    def learned(table: pa.Table) -> pa.Table:
                        values = np.column_stack([table.column(c).to_pandas().to_numpy(float) for c in columns])
                        return pa.table({**{b: table.column(b).slice(0, 1) for b in names}, "root": pa.array([json.dumps(_node_text(learn(values, boxes, params)))])})

                    roots = some.groupBy(*names).applyInArrow(learned, ", ".join(f"{b} long" for b in names) + ", root string").persist(StorageLevel.DISK_ONLY)
                    rows = rows.join(roots.hint("merge"), names)
                    whole = whole.join(roots.hint("merge"), names)

                def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        own = np.column_stack([batch.column(b).to_numpy(zero_copy_only=False) for b in names])
                        order = np.lexsort(own.T)
                        values = next(iter(dep.batches_to_rows(iter([batch]), columns)), np.zeros((0, len(columns))))
                        edges = np.flatnonzero(np.r_[True, (own[order][1:] != own[order][:-1]).any(1), True]) if len(own) else []
                        for a, z in zip(edges[:-1], edges[1:], strict=True):
                            root = stars if plain else _node_of(json.loads(batch.column("root")[int(order[a])].as_py()))
                            if out := tallies(root, values[order[a:z]], columns, grid):
                                found = tally_batch(out)
                                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(out), x)) for x in own[order[a]]], *found.columns], [*names, *found.schema.names])

                counts = added_up(rows.mapInArrow(task, ", ".join(f"{b} long" for b in names) + f", {TALLIES}"), names)
            counts = counts.persist(StorageLevel.DISK_ONLY)
            if plain:
                whole = whole.withColumn("root", F.lit(text))
            leaf = counts.where("col <> '' and substring(col, 1, 1) not in ('<', '>')")
            points = leaf.where(~F.col("col").isin(list(grid))) if grid else leaf
            domain = points.where("v is not null").select("col", "v").distinct()
            joined(leaves.histogram(points, domain, [*names, "node"]), "points", F.struct("node", "lo", "hi", "pdf", "non_null"))
            if grid:
                joined(leaf.where(F.col("col").isin(list(grid))), "places", F.struct("node", "col", "v", "n"))
            if not plain:
                joined(counts.where("col = '' or substring(col, 1, 1) in ('<', '>')"), "extent", F.struct("node", "col", "v", "n"))
        for c, kind in _MODEL.items():
            if c not in whole.columns:
                whole = whole.withColumn(c, F.lit(None).cast(kind))
        return CellTable(keys, columns, grid, whole.persist(StorageLevel.DISK_ONLY))

    # Estimates

    def _kept(self, spark: SparkSession, table: str, box: dict[str, tuple[float, float]]) -> DataFrame:
        """(bin_<key>, n, ndv_<key>, p) of a table's cells."""
        t = self.tables[table]
        if isinstance(t, CellTable):
            return t.filtered(box)
        rows = {f"bin_{k}": t.bins[:, i] for i, k in enumerate(t.keys)} | {"n": t.n} | {f"ndv_{k}": t.ndv[:, i] for i, k in enumerate(t.keys)} | {"p": t.selectivity(box, np.arange(len(t.n)))}
        return spark.createDataFrame(pa.table(rows))

    def solved(self, spark: SparkSession, node: JoinTree, boxes: dict[str, dict[str, tuple[float, float]]]) -> DataFrame:
        """`solve` on tables: (bin_<key>, n, ndv_<key>)."""
        keys, one = self.tables[node.table].keys, F.lit(1.0)
        out = self._kept(spark, node.table, boxes.get(node.table, {}))
        names = [f"bin_{k}" for k in keys]
        out = out.select(*names, (F.col("n") * F.col("p")).alias("n"), *[(F.col(f"ndv_{k}") * (1 - F.pow(1 - F.col("p"), F.col("n") / F.col(f"ndv_{k}")))).alias(f"ndv_{k}") for k in keys])
        for i, (key, child) in enumerate(node.children):
            low = self.projected(spark, child, boxes).select(F.col("bin").alias(f"bin_{key}"), F.col("n").alias(f"c_n{i}"), F.col("keys").alias(f"c_k{i}"))
            out = out.join(low, f"bin_{key}")
        n, plain, special = F.col("n"), [one], []
        for i, (key, _) in enumerate(node.children):
            below, own, apart = F.col(f"c_k{i}"), F.col(f"ndv_{key}"), F.col(f"bin_{key}") < 0
            n = n * F.when(below > 0, F.col(f"c_n{i}") / below).otherwise(0.0)
            plain.append(F.when(apart, one).otherwise(F.when(own > 0, below / own).otherwise(one)))
            special.append(F.when(apart, F.least(below, one)).otherwise(one))
        n = n * F.array_min(F.array(*plain))
        ranked = F.sort_array(F.array(*special)) if special else None
        for i in range(len(special)):
            n = n * F.pow(ranked[i], F.lit(1.0 / (i + 1)))
        return out.select(*names, n.alias("n"), *[f"ndv_{k}" for k in keys])

    def projected(self, spark: SparkSession, node: JoinTree, boxes) -> DataFrame:
        """`project` on tables: (bin, n, keys)."""
        at = F.col(f"bin_{node.key}")
        low, high = self.ranges.get(self.classes[node.table, node.key], (0.0, 0.0))
        w = F.when(at < 0, 1.0).otherwise(F.least(F.lit(float(self.width)), F.lit(float(high - low + 1)) - at * F.lit(float(self.width))))
        free = F.product(F.greatest(F.lit(0.0), 1 - F.col(f"ndv_{node.key}") / w))
        return self.solved(spark, node, boxes).groupBy(at.alias("bin"), w.alias("w")).agg(F.sum("n").alias("n"), free.alias("free")).select("bin", "n", (F.col("w") * (1 - F.col("free"))).alias("keys"))

    def keys_in(self, table: str, key: str, bins: np.ndarray) -> np.ndarray:
        """Whole keys that a bin can hold: 1 for a special value, the width, or what the range leaves of it for the last bin."""
        low, high = self.ranges.get(self.classes[table, key], (0.0, 0.0))
        return np.where(bins < 0, 1.0, np.minimum(self.width, high - low + 1 - bins * self.width))

    def solve(self, node: JoinTree, boxes: dict[str, dict[str, tuple[float, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, rows, distinct keys) of a table after its filter and its children; cells that a child lacks are left out."""
        t = self.tables[node.table]
        below = []
        some = np.arange(len(t.n))
        for key, child in node.children:
            at = t.keys.index(key)
            of, rows, keys = self.project(child, boxes)
            below.append((at, of, rows, keys))
            some = some[np.isin(t.bins[some, at], of)]
        p = t.selectivity(boxes.get(node.table, {}), some)
        n, ndv = t.n[some] * p, t.ndv[some] * (1 - (1 - p)[:, None] ** (t.n[some, None] / t.ndv[some]))
        shares, is_special = [], []
        own = ndv.copy()
        for at, of, rows, keys in below:
            j = np.searchsorted(of, t.bins[some, at])
            n = n * np.divide(rows[j], keys[j], out=np.zeros(len(j)), where=keys[j] > 0)
            special = t.bins[some, at] < 0
            shares.append(np.where(special, np.minimum(keys[j], 1.0), np.divide(keys[j], own[:, at], out=np.ones(len(j)), where=own[:, at] > 0)))
            is_special.append(special)
        if shares:
            share, special = np.array(shares), np.array(is_special)
            n = n * np.minimum(1.0, np.where(special, np.inf, share).min(0))
            ranked = np.sort(np.where(special, share, 1.0), axis=0)
            n = n * np.prod(ranked ** (1.0 / np.arange(1, len(ranked) + 1))[:, None], axis=0)
        return some, n, ndv

    def project(self, node: JoinTree, boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bins, rows, distinct keys) on the key to the parent, bins sorted."""
        t = self.tables[node.table]
        at = t.keys.index(node.key)
        some, n, ndv = self.solve(node, boxes)
        bins, where = np.unique(t.bins[some, at], return_inverse=True)
        w = self.keys_in(node.table, node.key, bins)
        free = np.ones(len(bins))
        np.multiply.at(free, where, np.maximum(0.0, 1 - ndv[:, at] / w[where]))
        return bins, np.bincount(where, n, len(bins)), w * (1 - free)

    @property
    def in_tables(self) -> bool:
        """Whether a table has more cells than the driver holds."""
        return any(isinstance(t, CellTable) for t in self.tables.values())

    def estimate(self, query: Query, root: str | None = None, hoist: bool = False) -> float:
        """Rows of the join. root: of the estimate, the last table by default, `best` for `best_root`; hoist: chains on one key first."""
        if root == "best":
            root = best_root(query, {t: c.frame.count() if isinstance(c, CellTable) else len(c.n) for t, c in self.tables.items()})
        tree = orient(query, root)
        if self.in_tables:
            tree = compressed(tree) if hoist else tree
            return float(self.solved(SparkSession.getActiveSession(), tree, query.boxes).agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0])
        return float(self.solve(compressed(tree) if hoist else tree, query.boxes)[1].sum())

    def estimates(self, queries: DataFrame) -> DataFrame:
        """(qid, estimate) of rows (qid, query), query as JSON of its three parts; the model goes to the tasks, queries are spread over them; where it has a CellTable, each query is a plan of its own."""
        if self.in_tables:
            spark, out = queries.sparkSession, queries.select(F.col("qid").cast("long").alias("qid"), F.lit(0.0).alias("estimate")).where("false")
            for r in queries.select("qid", "query").collect():
                q = query_of(r["query"])
                out = out.union(self.solved(spark, orient(q), q.boxes).agg(F.lit(r.qid).cast("long").alias("qid"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("estimate")))
            return out
        shared = queries.sparkSession.sparkContext.broadcast(self)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shared.value.estimate(query_of(q)) for q in batch.column("query").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array(found, pa.float64())], ["qid", "estimate"])

        return queries.select(F.col("qid").cast("long").alias("qid"), "query").mapInArrow(task, "qid long, estimate double")

    # Files

    def save(self, spark: SparkSession, path: str) -> None:
        rows, heads = [], []
        grid_text = lambda m: json.dumps({c: asdict(g) for c, g in m.grid.items()})
        for t, cells in self.tables.items():
            models = [m for m in cells.models if m is not None]
            heads.append((t, cells.keys, [self.classes[t, k] for k in cells.keys], cells.columns, grid_text(models[0]) if models and isinstance(models[0], Model) else "{}"))
            for i, m in enumerate(cells.models):
                kind = "none" if m is None else "sampled" if isinstance(m, Sampled) else "tree"
                text = json.dumps(None if m is None else m.rows.tolist() if kind == "sampled" else {"root": _node_text(m.root), "bins": m.bins, "weights": m.weights, "bounds": m.bounds})
                rows.append((t, i, cells.bins[i].tolist(), float(cells.n[i]), cells.ndv[i].tolist(), kind, text))
        spark.createDataFrame(rows, "table string, cell int, bins array<long>, n double, ndv array<double>, kind string, model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame(heads, "table string, keys array<string>, classes array<int>, columns array<string>, grid string").coalesce(1).write.mode("overwrite").parquet(f"{path}/tables")
        ranges = [(c, a, z, self.width) for c, (a, z) in self.ranges.items()]
        spark.createDataFrame(ranges, "class int, low double, high double, width double").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> JoinModel:
        tables, classes = {}, {}
        cells: dict[str, list] = {}
        for r in spark.read.parquet(f"{path}/cells").orderBy("table", "cell").collect():
            cells.setdefault(r.table, []).append(r)
        for head in spark.read.parquet(f"{path}/tables").collect():
            classes.update({(head.table, k): c for k, c in zip(head["keys"], head.classes, strict=True)})
            grid = {c: Grid(**g) for c, g in json.loads(head.grid).items()}
            rows, models = cells.get(head.table, []), []
            for r in rows:
                d = json.loads(r.model)
                if r.kind == "tree":
                    numbered = lambda x: {int(k): v for k, v in x.items()}
                    models.append(Model(head.columns, _node_of(d["root"]), int(r.n), numbered(d["bins"]), numbered(d["weights"]), numbered(d["bounds"]), grid))
                else:
                    models.append(None if d is None else Sampled(np.array(d, float).reshape(-1, len(head.columns))))
            shape = (len(rows), len(head["keys"]))
            tables[head.table] = Cells(list(head["keys"]), list(head.columns), np.array([r.bins for r in rows], np.int64).reshape(shape), np.array([r.n for r in rows]), np.array([r.ndv for r in rows]).reshape(shape), models)
        ranges = spark.read.parquet(f"{path}/ranges").collect()
        return cls(tables, classes, {r["class"]: (r.low, r.high) for r in ranges}, ranges[0].width if ranges else 1.0)


def query_text(query: Query) -> str:
    return json.dumps([query.tables, query.joins, query.boxes])


def query_of(text: str) -> Query:
    tables, joins, boxes = json.loads(text)
    return Query(tables, [tuple(j) for j in joins], {t: {c: tuple(b) for c, b in box.items()} for t, box in boxes.items()})


def parse(text: str) -> tuple[Query, float | None]:
    """A line `t1,t2#t1.a=t2.b#t1.x,>,5,t2.y,=,3#123` of a workload: tables, joins, predicates in triples, true rows. Strict bounds exclude their value. Operators other than <, <=, =, >=, > are an error."""
    tables, joins, predicates, *card = text.strip().split("#")
    names = tables.split(",")
    pairs = [tuple(p for side in j.split("=") for p in side.strip().split(".")) for j in joins.split(",") if j]
    words = [w for w in predicates.split(",") if w]
    boxes: dict[str, dict[str, tuple[float, float]]] = {}
    for ref, op, value in zip(words[::3], words[1::3], words[2::3], strict=True):
        t, c = ref.split(".")
        v = float(value)
        sides = {"<": (-np.inf, np.nextafter(v, -np.inf)), "<=": (-np.inf, v), "=": (v, v), ">=": (v, np.inf), ">": (np.nextafter(v, np.inf), np.inf)}
        if op not in sides:
            raise ValueError(f"operator {op}")
        lo, hi = boxes.setdefault(t, {}).get(c, (-np.inf, np.inf))
        boxes[t][c] = (max(lo, sides[op][0]), min(hi, sides[op][1]))
    return Query(names, pairs, boxes), float(card[0]) if card and card[0] else None

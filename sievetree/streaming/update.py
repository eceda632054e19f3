"""Incremental update: statements come in micro-batches, rows are added to or taken from the model's counts, drifting parts are learned anew.

Three methods: `none` answers with the model as it is, `retrain` learns anew at every update, `adaptive` routes new rows down the tree,
adds their counts to those kept, and learns anew only the subtrees whose check fails: two column groups of a product have become
dependent, a sum's rows are over 1.3 times as far from their centres as they were, or a split parts new queries under 0.7 times as
well. A subtree that is learned anew keeps its columns; only its own nodes are counted again, over the rows that reach it.

Files, all in one folder that the executors share: `rows` (a folder for each batch, so a batch is written once and no row is written
again), and for each state the counts, a uniform sample of all rows so far (the rows with the smallest random numbers, which are kept
beside them), the model, and last the state's own row with the batches it holds. A batch that comes again after a failure or a
restart finds its number there and is left out. A new Updater on the folder goes on from its last whole state; the two states before
it are kept.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dependence as dep
from ..operators import workload_stats as ws
from ..plans.tree import Grid, Model, Node, Params, added_up, count, learn

#: Limits of the drift checks, and queries to an update.
DISTANCE_LIMIT, EDGE_LIMIT, SPLIT_LIMIT, QUERIES = 1.3, 0.3, 0.7, 20
SAMPLE = 5000


def spread(node: Node, rows: np.ndarray) -> float:
    """Mean squared distance of rows to the nearest centre of a sum."""
    some = rows[:, node.columns]
    some = np.where(np.isfinite(some), some, node.fill)
    return float(np.min([((some - c) ** 2).sum(1) for c in np.array(node.centres)], axis=0).mean()) if len(some) else 0.0


def sides_of(node: Node, rows: np.ndarray) -> np.ndarray:
    """The child of a sum that each row goes to."""
    some = rows[:, node.columns]
    return dep.nearest(np.where(np.isfinite(some), some, node.fill), np.array(node.centres))


def mask_groups(node: Node, boxes: np.ndarray) -> list[tuple[int, int]]:
    """(mask of the node's columns, queries)."""
    used = np.isfinite(boxes[:, node.columns]).any(axis=2)
    masks, n = np.unique((used * (1 << np.arange(len(node.columns)))).sum(1), return_counts=True)
    return [(m, k) for m, k in zip(masks.tolist(), n.tolist(), strict=True) if m]


def drifted(root: Node, old: np.ndarray, new: np.ndarray, old_boxes: np.ndarray | None = None, new_boxes: np.ndarray | None = None, least: int = 50) -> list[int]:
    """Numbers of the topmost nodes whose check fails, on bounded samples of old and new rows routed down the tree; a node that fewer than `least` new rows reach is not checked."""
    out: list[int] = []

    def go(node: Node, old: np.ndarray, new: np.ndarray) -> None:
        if len(new) < least or node.kind == "leaf":
            return
        bad = False
        if node.kind == "sum":
            bad = spread(node, new) > DISTANCE_LIMIT * max(spread(node, old), 1e-12)
        elif node.kind == "product" and node.by == "data":
            now, before = dep.rdc(new[:, node.columns]), dep.rdc(old[:, node.columns]) if len(old) >= least else None
            at = {c: i for i, c in enumerate(node.columns)}
            pairs = [(at[a], at[b]) for i, x in enumerate(node.children) for y in node.children[:i] for a in x.columns for b in y.columns]
            bad = any(now[a, b] >= max(EDGE_LIMIT, (before[a, b] if before is not None else 0.0) + EDGE_LIMIT / 2) for a, b in pairs)
        elif node.kind == "split" and old_boxes is not None and new_boxes is not None and len(new_boxes):
            was, now = ws.cut_share(mask_groups(node, old_boxes), node.masks), ws.cut_share(mask_groups(node, new_boxes), node.masks)
            bad = now < SPLIT_LIMIT * was
        if bad:
            out.append(node.number)
        elif node.kind == "sum":
            mine, its = sides_of(node, old), sides_of(node, new)
            for i, child in enumerate(node.children):
                go(child, old[mine == i], new[its == i])
        elif node.kind == "factorize":
            go(node.children[0], old, new)
            for i, child in enumerate(node.children[1:]):
                go(child, old[node.in_box(i, old)], new[node.in_box(i, new)])
        else:
            for child in node.children:
                go(child, old, new)

    go(root, old, new)
    return out


def rebuilt(root: Node, bad: Sequence[int], rows: np.ndarray, boxes: np.ndarray, params: Params) -> tuple[Node, dict[int, int], set[int]]:
    """The tree with the subtrees numbered in bad learned anew from the rows that reach them; kept nodes' numbers, old to new; the new nodes' numbers."""
    kept: list[tuple[int, Node]] = []

    def go(node: Node, rows: np.ndarray) -> Node:
        if node.number in bad:
            fresh = learn(rows[:, node.columns], boxes[:, node.columns] if len(boxes) else np.zeros((0, len(node.columns), 2)), params)
            for n in fresh.walk():
                n.columns = [node.columns[c] for c in n.columns]
                n.given = [node.columns[c] for c in n.given]
            return fresh
        out = replace(node, children=[])
        kept.append((node.number, out))
        if node.kind == "sum":
            at = sides_of(node, rows)
            out.children = [go(c, rows[at == i]) for i, c in enumerate(node.children)]
        elif node.kind == "factorize":
            out.children = [go(node.children[0], rows), *(go(c, rows[node.in_box(i, rows)]) for i, c in enumerate(node.children[1:]))]
        else:
            out.children = [go(c, rows) for c in node.children]
        return out

    out = go(root, rows)
    for i, node in enumerate(out.walk()):
        node.number = i
    numbers = {old: node.number for old, node in kept}
    return out, numbers, set(range(sum(1 for _ in out.walk()))) - set(numbers.values())


class Updater:
    """`path` is in a folder all executors share; table: the rows at the start, which later states do not copy."""

    def __init__(self, table: DataFrame, columns: list[str], boxes: np.ndarray, path: str, method: str = "adaptive", params: Params | None = None):
        if method not in ("none", "retrain", "adaptive"):
            raise ValueError(method)
        self.spark, self.columns, self.boxes, self.path, self.method, self.params = table.sparkSession, list(columns), boxes, path, method, params or Params()
        self.base = table.select(*[F.col(c).cast("double").alias(c) for c in columns])
        self.rebuilt = 0
        self.batches: dict[str, int] = {}
        self.version = self._last()
        if self.version is None:
            self.version = 0
            self.model = Model.fit(self.base, self.columns, boxes, self.params)
            self._keep(self._turned(self.base), count(self.base, self.columns, self.model.root, self.model.grid))
        else:
            at = f"{path}/state-{self.version}"
            state = self.spark.read.parquet(f"{at}/state").first()
            self.batches = json.loads(state.batches)
            self.rebuilt = state.rebuilt
            self.model = Model.load(self.spark, f"{at}/model")
            self.counts, self.sample = self.spark.read.parquet(f"{at}/counts"), self.spark.read.parquet(f"{at}/sample")

    # Files

    def _folder(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> int | None:
        """The number of the last state whose own row was written; it is written last."""
        p, files = self._folder("")
        if not files.exists(p):
            return None
        numbers = [int(f.getPath().getName().split("-")[1]) for f in files.listStatus(p) if f.getPath().getName().startswith("state-")]
        whole = [n for n in numbers if files.exists(self._folder(f"state-{n}/state/_SUCCESS")[0])]
        return max(whole, default=None)

    def _turned(self, df: DataFrame) -> DataFrame:
        return df.withColumn("turn", F.rand(17 + self.version)).orderBy("turn").limit(SAMPLE)

    def _keep(self, sample: DataFrame, counts: DataFrame) -> None:
        at = f"{self.path}/state-{self.version}"
        counts.write.mode("overwrite").parquet(f"{at}/counts")
        sample.write.mode("overwrite").parquet(f"{at}/sample")
        self.model.save(self.spark, f"{at}/model")
        self.spark.createDataFrame([(self.version, json.dumps(self.batches), self.rebuilt)], "version int, batches string, rebuilt int").coalesce(1).write.mode("overwrite").parquet(f"{at}/state")
        self.counts, self.sample = self.spark.read.parquet(f"{at}/counts"), self.spark.read.parquet(f"{at}/sample")
        p, files = self._folder(f"state-{self.version - 3}")
        if self.version >= 3 and files.exists(p):
            files.delete(p, True)

    def _part(self, kind: str, stream: str, number: int) -> str:
        return f"{self.path}/rows/{kind}-{stream}-{number:09d}"

    def _added(self, kind: str) -> DataFrame | None:
        parts = [self._part(kind, s.split("/")[1], n) for s, last in self.batches.items() if s.startswith(kind) for n in range(last + 1)]
        there = [p for p in parts if self._folder("")[1].exists(self.spark._jvm.org.apache.hadoop.fs.Path(p))]
        return self.spark.read.parquet(*there) if there else None

    @property
    def rows(self) -> DataFrame:
        """All rows there are now."""
        out, more, gone = self.base, self._added("new"), self._added("gone")
        out = out if more is None else out.unionByName(more)
        return out if gone is None else out.exceptAll(gone)

    def _sample(self, df: DataFrame, n: int = SAMPLE) -> np.ndarray:
        ordered = df.orderBy(F.rand(17)).limit(n)
        return np.array([tuple(np.nan if x is None else x for x in r) for r in ordered.collect()], float).reshape(-1, len(self.columns))

    def _kept_sample(self) -> np.ndarray:
        return np.array([tuple(np.nan if x is None else x for x in r) for r in self.sample.select(*self.columns).collect()], float).reshape(-1, len(self.columns))

    # Updates

    def _widened(self, new: DataFrame) -> DataFrame:
        """The counts so far, where columns counted by intervals have an interval more for new values below or above all, and one for the gap before them."""
        cut, counts = list(self.model.grid), self.counts
        if not cut:
            return counts
        ends = []
        for i, c in enumerate(cut):
            first, last = self.model.grid[c].edges[0], self.model.grid[c].edges[-1]
            under, over = F.when(F.col(c) < first, F.col(c)), F.when(F.col(c) > last, F.col(c))
            ends += [F.min(under).alias(f"a{i}"), F.max(under).alias(f"b{i}"), F.min(over).alias(f"y{i}"), F.max(over).alias(f"z{i}")]
        found = new.agg(*ends).first()
        place = F.col("v")
        for i, c in enumerate(cut):
            grid = self.model.grid[c]
            if found[f"z{i}"] is not None:
                # Intervals hold their lower edge: that of the gap is the largest value so far, that of the new ones their smallest.
                grid.edges += [found[f"y{i}"], np.nextafter(found[f"z{i}"], np.inf)]
                grid.alone += [found[f"y{i}"] == found[f"z{i}"], False]
            if found[f"a{i}"] is not None:
                grid.edges[:0] = [found[f"a{i}"], np.nextafter(found[f"b{i}"], np.inf)]
                grid.alone[:0] = [found[f"a{i}"] == found[f"b{i}"], False]
                place = F.when((F.col("col") == c) & F.col("v").isNotNull(), F.col("v") + 4).otherwise(place)
        return counts.withColumn("v", place)

    def _next(self, kind: str, df: DataFrame, number: int | None, stream: str) -> DataFrame | None:
        """The batch as written, or nothing if it was here before."""
        key = f"{kind}/{stream}"
        number = self.batches.get(key, -1) + 1 if number is None else number
        if number <= self.batches.get(key, -1):
            return None
        target = self._part(kind, stream, number)
        df.select(*[F.col(c).cast("double").alias(c) for c in self.columns]).write.mode("overwrite").parquet(target)
        self.batches[key] = number
        self.version += 1
        return self.spark.read.parquet(target)

    def insert(self, new: DataFrame, number: int | None = None, stream: str = "main", queries: np.ndarray | None = None) -> list[int]:
        """Adds rows; returns the nodes that drifted. A batch whose number its stream had before is left out. queries: boxes asked since the last update."""
        new = self._next("new", new, number, stream)
        if new is None:
            return []
        sample = self.sample.unionByName(self._turned(new)).orderBy("turn").limit(SAMPLE)
        if self.method == "none":
            self._keep(sample, self.counts)
            return []
        bad = drifted(self.model.root, self._kept_sample(), self._sample(new), self.boxes, queries) if self.method == "adaptive" else [0]
        if queries is not None and len(queries):
            self.boxes = np.concatenate([self.boxes, queries]) if len(self.boxes) else queries
        total = self.model.rows + new.count()
        if self.method == "retrain":
            self.rebuilt += 1
            self.model = Model.fit(self.rows, self.columns, self.boxes, self.params)
            self._keep(sample, count(self.rows, self.columns, self.model.root, self.model.grid))
            return bad
        root, grid = self.model.root, self.model.grid
        kept = self._widened(new)
        counts = added_up(kept.unionAll(count(new, self.columns, root, grid)))
        if bad:
            self.rebuilt += 1
            sample.write.mode("overwrite").parquet(f"{self.path}/state-{self.version}/drawn")
            sample = self.spark.read.parquet(f"{self.path}/state-{self.version}/drawn")
            drawn = np.array([tuple(np.nan if x is None else x for x in r) for r in sample.select(*self.columns).collect()], float).reshape(-1, len(self.columns))
            root, numbers, fresh = rebuilt(root, bad, drawn, self.boxes, self.params)
            moved = self.spark.createDataFrame([(a, b) for a, b in numbers.items()], "node int, now int")
            # A row for each node of the tree.
            counts = counts.join(F.broadcast(moved), "node").select(F.col("now").alias("node"), "col", "v", "n")
            counts = counts.unionAll(count(self.rows, self.columns, root, grid, fresh))
        self._adopt(root, total, counts, sample, grid)
        return bad

    def _adopt(self, root: Node, total: int, counts: DataFrame, sample: DataFrame, grid: dict[str, Grid]) -> None:
        target = f"{self.path}/state-{self.version}/merged"
        counts.write.mode("overwrite").parquet(target)
        counts = self.spark.read.parquet(target)
        self.model = Model.from_counts(self.columns, root, total, counts, grid)
        self._keep(sample, counts)

    def delete(self, gone: DataFrame, number: int | None = None, stream: str = "main") -> None:
        """Takes rows away; rows that are not there are an error. The sample keeps the rows it has: it serves the structure only."""
        gone = self._next("gone", gone, number, stream)
        if gone is None:
            return
        if self.method == "none":
            self._keep(self.sample, self.counts)
            return
        root, grid = self.model.root, self.model.grid
        minus = count(gone, self.columns, root, grid).withColumn("n", -F.col("n"))
        # Bounds are of rows that were there once; counts that reach 0 leave their value empty.
        counts = added_up(self.counts.unionAll(minus.where("substring(col, 1, 1) not in ('<', '>')")))
        n = F.when(F.col("n") < 0, F.raise_error(F.lit("rows to delete are not there")).cast("long")).otherwise(F.col("n"))
        bound = F.substring("col", 1, 1).isin("<", ">")
        counts = counts.withColumn("n", n).where(bound | (F.col("n") > 0))
        self._adopt(root, self.model.rows - gone.count(), counts, self.sample, grid)

    def answer(self, workload: DataFrame) -> DataFrame:
        return self.model.estimate(workload)

    def sink(self, stream: str | None = None):
        """For writeStream.foreachBatch over rows of the table: each micro-batch is inserted once, also if it comes again after a failure. With a name for the stream that holds after a restart too."""
        stream = stream or uuid.uuid4().hex

        def batch(df: DataFrame, number: int) -> None:
            self.insert(df, number, stream)

        return batch


def true_rows(base: DataFrame, columns: list[str], statements: DataFrame) -> DataFrame:
    """(seq, card) of the queries among statements (seq, is_insert, lo, hi), a stated list: rows of base and rows inserted before the query that its box holds. Each task counts its rows for every query; the counts are added up."""
    rows = statements.orderBy("seq").collect()
    asked = [r for r in rows if not r.is_insert]
    seq = np.array([r.seq for r in asked], np.int64)
    lo, hi = (np.array([r[k] for r in asked], float).reshape(-1, len(columns)) for k in ("lo", "hi"))

    def counted(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.array([((values >= a) & (values <= z) | ~np.isfinite(a) & ~np.isfinite(z)).all(1)[at < s].sum() for a, z, s in zip(lo, hi, seq, strict=True)], np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(seq), np.int64)
        for batch in batches:
            at = batch.column("seq").to_numpy()
            for values in dep.batches_to_rows(iter([batch]), columns):
                total += counted(values, at)
        yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(total)], ["seq", "n"])

    before = base.select(F.lit(-1).cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in columns])
    new = statements.where("is_insert").select("seq", *[F.col("lo")[i].alias(c) for i, c in enumerate(columns)])
    return before.unionByName(new).mapInArrow(task, "seq long, n long").groupBy("seq").agg(F.sum("n").alias("card"))


def intervals(updater: Updater, statements: DataFrame, parts: int = 10) -> list[dict]:
    """Replays statements (seq, is_insert, lo, hi) in order: queries are answered by the model as it stands, and every QUERIES-th query first brings in the rows inserted since. For each of `parts` intervals of about as many queries: seconds, mean q-error, and the mean without the worst. Queries without a true row have no q-error."""
    rows = statements.orderBy("seq").collect()
    card = {r.seq: r.card for r in true_rows(updater.base, updater.columns, statements).collect()}
    asked = sum(not r.is_insert for r in rows)
    names, spark = updater.columns, updater.spark
    out, errors, began, done, waiting, boxes = [], [], time.time(), 0, [], []
    for r in rows:
        if r.is_insert:
            waiting.append(tuple(r.lo))
            continue
        lo, hi = np.array(r.lo, float), np.array(r.hi, float)
        boxes.append(np.stack([lo, hi], 1))
        if len(boxes) == QUERIES:
            if waiting:
                updater.insert(spark.createDataFrame(waiting, ", ".join(f"`{c}` double" for c in names)), queries=np.array(boxes))
            waiting, boxes = [], []
        estimate = max(1.0, round(updater.model.probability(lo, hi) * updater.model.rows))
        if card[r.seq]:
            errors.append(max(estimate / card[r.seq], card[r.seq] / estimate))
        done += 1
        if done * parts // asked > len(out):
            best = sorted(errors)[:-1]
            out.append({"interval": len(out) + 1, "seconds": time.time() - began, "mean": float(np.mean(errors)) if errors else None, "mean_without_worst": float(np.mean(best)) if best else None, "rows": updater.model.rows})
            errors, began = [], time.time()
    return out

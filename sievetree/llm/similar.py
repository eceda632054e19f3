"""What completes SimHash near-dedup: all documents whose sets of word shingles have a Jaccard similarity of at least 4/5.

At that similarity 64-bit fingerprints differ in about ten bits, too many for any grid, so the fingerprints (of `simhash`, here over the
set of five-word shingles) find the closest pairs first, which links most copies at little cost: pairs at 3 bits or fewer, by the
segment popcounts and the grid, verified on whole sets. An exact similarity join finds every other pair.

Words are those of `simhash`; a document is the set of its shingles of `width` words, as 64-bit hashes (a text of fewer words has one
shingle, all texts without words have the same one). Documents with equal sets are one node from the start.

Two sets of similarity 4/5 or more have a shingle in common among the n - ceil(4n/5) + 1 smallest of each, in whatever order, as long as
it is the same for all (prefix filter). The order puts shingles that a small sample of the documents repeats last: it decides how many
candidates there are, never which links are found. Candidates are compared by the size of their intersection.

The fingerprints' links first. Then stars: in each prefix shingle's list of documents with several components, every one is compared with
one centre. Then the pairs of each list that are not in one component yet: those outside the component that holds most of the list, with each other and with it. So a group of copies, however
large, takes no pairs of all with all; what its stars left out is compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import side, small_batches, temporary, texts, without, written
from . import simhash
from .simhash import components

WIDTH = 5
#: Documents in the sample that the order is taken from, and how many repeated shingles of it are told apart.
SAMPLE, TOLD_APART = 5000, 100_000
STARS = 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The set of hashes, sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w) for w in words], np.uint64)
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ each[i : i + n]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(hashes: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), 2), np.uint64).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The n - ceil(4n/5) + 1 smallest shingles by how often the sample has them, then by hash. common is sorted."""
    n = len(hashes)
    seen = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.argsort(seen, kind="stable")][: n - (4 * n + 4) // 5 + 1]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _parts(batch: pa.RecordBatch, most: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def order(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, sorted, and how many have each."""
    rows = texts(docs)
    step = rows.count() // SAMPLE + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t.as_py(), width) for t in part.column("text")]).view(np.int64))], ["shingle"])

    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(step)) == 0).mapInArrow(task, "shingle long")
    found = some.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(TOLD_APART).toArrow()
    common, times = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    at = np.argsort(common)
    return common[at], times[at]


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is 1 if set in over half of their hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def prefixes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, node, fp, n, prefix): of each document the digest, the fingerprint and the size of its set, and the shingles that candidates share."""
    common, times = order(docs, width)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets = [shingles(t.as_py(), width) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), _lists([prefix(s, common, times) for s in sets])], ["doc_id", "node", "fp", "n", "prefix"])

    return texts(docs).mapInArrow(task, "doc_id long, node long, fp long, n int, prefix array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle, then node: those of shingles that several nodes have. Nothing but the last row is held."""
    last, told = None, False
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("shingle", "node", "n")]
        if not len(rows[0]):
            continue
        if last is not None:
            rows = [np.r_[x, y] for x, y in zip(last, rows, strict=True)]
        new = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
        rows = [x[new] for x in rows]
        same = rows[0][1:] == rows[0][:-1]
        keep = np.r_[told, same] | np.r_[same, False]
        last, told = [x[-1:] for x in rows], bool(keep[-1])
        keep[-1] = False  # comes with the next batch, or below
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], ["shingle", "node", "n"])
    if last is not None and told:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], ["shingle", "node", "n"])


def _sets(docs: DataFrame, ids: DataFrame, most: int, width: int) -> DataFrame:
    """(node, hashes) of the documents named, at most `most`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                values = [shingles(t.as_py(), width) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in values], pa.int64()), _lists(values)], ["node", "hashes"])

    return texts(docs).join(side(ids, most), "doc_id", "left_semi").mapInArrow(task, "node long, hashes array<long>").dropDuplicates(["node"])


def _alike(docs: DataFrame, pairs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose sets have 4/5 of their union in common. pairs: (a, b, n_a, n_b), a row for each prefix shingle in common.

    Of two sets, the one whose prefix ends first shares with the other's prefix all that its prefix shares with the other at all, so the
    intersection is at most that of the prefixes and all behind the prefix. Only pairs that can suffice have whole sets made and compared.
    """
    able = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    rest = F.ceil(4 * F.greatest("n_a", "n_b") / 5) - 1
    return _verified(docs, able.where(9 * (F.col("c") + rest) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b"), found, width)


def _verified(docs: DataFrame, able: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 4/5 of their union in common."""
    able = written(able, "similar-candidates")
    # Written, so that few nodes and ids are known to be few and the texts stay where they are.
    nodes = written(able.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-nodes")
    n = nodes.count()
    ids = written(found.select("node", "doc_id").join(side(nodes, n), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "similar-ids")
    sets = written(_sets(docs, ids, n, width), "similar-sets")
    one, two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    common = F.size(F.array_intersect("ha", "hb"))
    return able.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(9 * common >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b")


def closest(docs: DataFrame, found: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pairs (a, b) of nodes of similarity 4/5 or more among those whose fingerprints link: the first node of a fingerprint stands for it, others of the same fingerprint are compared with it."""
    nodes = written(found.select("node", "fp").distinct(), "similar-prints")
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "similar-heads")
    n = heads.count()
    same = nodes.join(side(heads, n), "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    one, two = heads.select(F.col("fp").alias("x"), F.col("head").alias("a")), heads.select(F.col("fp").alias("y"), F.col("head").alias("b"))
    near = simhash.links(heads.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y")).join(side(one, n), "x").join(side(two, n), "y").select("a", "b")
    return _verified(docs, same.unionByName(near), found, width)


def links(docs: DataFrame, width: int = WIDTH, found: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes of similarity 4/5 or more that connect all such pairs."""
    found = written(prefixes(docs, width), "shingle-prefixes") if found is None else found
    rows = found.select("node", "n", F.explode("prefix").alias("shingle")).repartition("shingle").sortWithinPartitions("shingle", "node")
    lists = written(rows.mapInArrow(_shared, "shingle long, node long, n int"), "shingle-lists")
    nodes = written(lists.select("node").distinct(), "shingle-nodes")
    n, most = nodes.count(), lists.count() // 2  # a list has two nodes or more

    def labelled(edges: DataFrame) -> DataFrame:
        return written(nodes.join(side(components(edges), n), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "similar-roots")

    edges = written(closest(docs, found, width), "similar-pairs")
    label = labelled(edges)
    for star in range(STARS + 1):
        held = lists.join(side(label, n), "node")
        open_lists = held.groupBy("shingle", "root").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("top")).where("roots > 1")
        held = held.join(side(open_lists.select("shingle", F.col("top.root").alias("most")), most), "shingle")
        if star < STARS:
            # A centre is the node of a list that comes first in an order of this round. Pairs are counted in the lists it is the centre of
            # only, so some are passed over here; the last round has them.
            centre = held.groupBy("shingle").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", F.lit(star))).alias("c"))
            pairs = held.join(side(centre, most), "shingle").where(F.col("root") != F.col("c.root")).select(F.col("node").alias("a"), F.col("c.node").alias("b"), F.col("n").alias("n_a"), F.col("c.n").alias("n_b"))
        else:
            held = written(held, "open-lists")
            few = held.where(F.col("root") != F.col("most")).select("shingle", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("own"))
            once = (F.col("root") == F.col("most")) | (F.col("a") < F.col("node"))
            pairs = held.join(side(few, few.count()), "shingle").where((F.col("own") != F.col("root")) & once)
            pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), F.when(F.col("a") < F.col("node"), F.col("n_a")).otherwise(F.col("n")).alias("n_a"), F.when(F.col("a") < F.col("node"), F.col("n")).otherwise(F.col("n_a")).alias("n_b"))
        pairs = pairs.where(5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
        new = written(_alike(docs, pairs, found, width), "similar-pairs")
        edges = edges.unionAll(new)
        if star < STARS:
            label = labelled(edges)
    return edges


def copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, component_id) of the documents that have an id; component_id is the smallest id reachable over similar pairs."""
    docs = docs.where(F.col("doc_id").cast("long").isNotNull())
    found = written(prefixes(docs, width), "shingle-prefixes")
    roots = components(links(docs, width, found))
    n = found.count()
    member = found.select("doc_id", "node").join(side(roots, n), "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    lowest = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return member.join(side(lowest, n), "root").select("doc_id", "component_id")


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that stay: of each component, the document with the smallest id; rows without an id stay."""
    with temporary(docs.sparkSession), small_batches(docs.sparkSession):
        drop = written(copies(docs, width).where("doc_id <> component_id").select("doc_id"), "similar-dropped", kept=True)
    return without(docs, drop)

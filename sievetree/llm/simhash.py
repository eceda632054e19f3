"""SimHash near-duplicate detection with a segment-popcount embedding.

Fingerprints: words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, shingles of `width` words (repeats included), XXH64 with
seed 42 of each; a bit is 1 if set in over half of the hashes. A text of fewer words has one shingle, of no words the fingerprint 0.

Search: a fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints, so links at `radius` 3 are among the embeddings within 3. A grid of cell width 4 over
all 32 axes would need 3**32 neighbour cells, so the range join goes by groups of axes: the 32 axes are dealt into seven groups; with
total distance 3 at most three groups differ, so any linked pair agrees on all axes of four groups: the grid has a layer for each of the
35 sets of four groups, its cells are the exact coordinates there (18 axes or more, so that cells stay small when the corpus grows), and
the range join joins within cells. In a cell, pairs beyond Manhattan distance 3 are dropped, the rest verified by Hamming distance, and only a spanning
forest of the verified links leaves the task: connectivity is kept, pairs are never all emitted. Cells of over `block` distinct
fingerprints are cut into blocks; every pair of blocks is a task of its own, so no cell is gathered whole and none is capped.

Components over the forest edges use alternating large and small stars, each round written to the shared folder.

Defined results: null text is the empty text; all texts without words share fingerprint 0 and are linked; rows that repeat an id are
each reported; a null id is never the smallest unless a component has no other (component_id is then null). Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, side, temporary, texts, written

WIDTH, RADIUS, BLOCK = 3, 3, 8192
_EVEN = 0x5555555555555555
#: Bits of the seven groups of segments: 5, 5, 5, 5, 4, 4 and 4 segments of two bits.
_GROUP_BITS = (10, 10, 10, 10, 8, 8, 8)
_SMALL_RUN = 24


def fingerprint(text: str, width: int = WIDTH, part: int = 65536) -> int:
    """Of one text; hashes are counted a part at a time, so that memory does not grow with the text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, part):
        some = words[at : at + part + width - 1]
        if len(words) < width:
            hashes = [digest(b" ".join(some), 42)]
        else:
            rows = [some[i : len(some) - width + 1 + i] for i in range(width)]
            hashes = [digest(b" ".join(x), 42) for x in zip(*rows, strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp), fp as a signed 64-bit number."""
    return texts(docs).mapInArrow(lambda b: _fingerprints(b, width), "doc_id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, packed two bits each."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(_EVEN))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed embeddings. In a segment the counts 0, 1, 2 differ by 1 if exactly one of them is odd, by 2 if they are 0 and 2."""
    x = a ^ b
    odd = x & np.uint64(_EVEN)
    two = (x >> np.uint64(1)) & np.uint64(_EVEN) & ~odd
    return np.bitwise_count(odd) + 2 * np.bitwise_count(two)


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints: each one is compared once with those not yet reached."""
    fp = np.unique(fp)
    grid = embed(fp)
    left, out, frontier = np.arange(len(fp)), [], []
    while len(left):
        if not frontier:
            frontier, left = [left[0]], left[1:]
        at = frontier.pop()
        near = manhattan(grid[left], grid[at]) <= RADIUS
        near[near] = np.bitwise_count(fp[left[near]] ^ fp[at]) <= RADIUS
        hits = left[near]
        if len(hits):
            out += [(fp[at], fp[h]) for h in hits]
            frontier += list(hits)
            left = left[~near]
    return out


def _cell_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by cell. Short runs are compared by offset, all at once; long ones one by one."""

    def edges(pairs) -> pa.RecordBatch:
        a = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
        b = np.array([p[1] for p in pairs], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def solve(cell: np.ndarray, fp: np.ndarray):
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        lengths = np.diff(np.r_[starts, len(cell)])
        for s, n in zip(starts[lengths > _SMALL_RUN], lengths[lengths > _SMALL_RUN], strict=True):
            yield from forest(fp[s : s + n])
        small = np.repeat((lengths <= _SMALL_RUN) & (lengths > 1), lengths)
        cell, fp = cell[small], fp[small]
        grid = embed(fp)
        for d in range(1, min(_SMALL_RUN, len(fp))):
            same = np.flatnonzero(cell[d:] == cell[:-d])
            if not len(same):
                break
            hit = same[manhattan(grid[same], grid[same + d]) <= RADIUS]
            hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + d]) <= RADIUS]
            hit = hit[fp[hit] != fp[hit + d]]
            yield from zip(fp[hit], fp[hit + d], strict=True)

    held_cell, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        cell = np.r_[held_cell, batch.column("task").to_numpy()]
        fp = np.r_[held_fp, batch.column("fp").to_numpy().view(np.uint64)]
        cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        held_cell, held_fp = cell[cut:], fp[cut:]
        if pairs := list(solve(cell[:cut], fp[:cut])):
            yield edges(pairs)
    if len(held_cell) and (pairs := list(solve(held_cell, held_fp))):
        yield edges(pairs)


def _layers() -> list[tuple[int, int]]:
    """Masks of the grid's layers: all groups but RADIUS each."""
    masks, at = [], 0
    for bits in _GROUP_BITS:
        masks.append(((1 << bits) - 1) << at)
        at += bits
    return [(k, sum(some)) for k, some in enumerate(combinations(masks, len(masks) - RADIUS))]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Forest edges (a, b) that connect all fingerprints within the radius; distinct: one column fp, no repeats."""
    high, low = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_EVEN)), F.col("fp").bitwiseAND(F.lit(_EVEN))
    packed = F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))
    layer = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), packed.bitwiseAND(F.lit(_signed(m))).alias("coord")) for k, m in _layers()])).alias("x")
    cells = distinct.select("fp", layer).select("fp", F.xxhash64("x.layer", "x.coord").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # Half of the rows of cells may be cells of several.
    placed = cells.join(side(sizes, distinct.count() * len(_layers()) // 2), "cell").withColumn("k", F.ceil(F.col("n") / F.lit(block)).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int"))
    # In a cell of k blocks, a row goes to the tasks (own, j) for each j; k is 1 but for hot cells. At most one pair of blocks is gathered.
    tasks = placed.select("fp", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    tasks = tasks.select("fp", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    found = tasks.repartition("task").sortWithinPartitions("task", "fp").mapInArrow(_cell_edges, "a long, b long")
    return found.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge; root is the smallest node reachable. Large and small stars alternate until nothing changes, in a number of rounds about logarithmic in the nodes. Stars are found by aggregation; each round is written and the one before removed."""
    spark = edges.sparkSession
    path = scratch(spark, "stars")
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "stars", path)
    state = None
    most = 2 * now.count()  # nodes with an edge; no round has more
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(side(low, most), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(low, most), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new_path = scratch(spark, "stars")
        now = written(small, "stars", new_path)
        new_state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        remove(spark, path)
        path = new_path
        if tuple(new_state) == state:
            break
        state = tuple(new_state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, width), "fingerprints")
    with temporary(docs.sparkSession):
        distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
        roots = components(links(distinct.select("fp"), block))
        n = distinct.count()
        member = distinct.join(side(roots, n), distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
        lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
        classes = written(member.join(side(lowest, n), "root").select("fp", "component_id"), "classes", kept=True)
    return prints.join(side(classes, n), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, width: int | None = None) -> DataFrame:
    """The rows of docs that stay when one document of each group of near copies does, that with the smallest id; rows without an id stay. Near copies have a Jaccard similarity of 4/5 or more on shingles of five words: fingerprints link the closest, verified; `similar` finds the rest."""
    from . import similar  # which builds on this module

    return similar.dedup(docs, width or similar.WIDTH)

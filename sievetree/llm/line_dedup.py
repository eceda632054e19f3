"""Line deduplication by pairwise alignment.

Documents are ordered by id. Which documents overlap is found through line hashes, each pair found is aligned as patience diff does, and
the lines of common blocks are deleted from the later document. A block is a run of neighbouring lines that are equal in both, of at
least `min_words` words; 1 makes every common line a block. The default leaves alone what clean documents share by chance.

* Pairs. A rare line, one that 2 to `rare` documents have, pairs all of them: at most rare*(rare-1)/2 rows a line. Lines that more
  documents have make no pairs by themselves, but none is dropped: every shortest run of `min_words` words that consists of such
  lines only is hashed whole, and pairs each document with the earliest that has the run. So a run that an earlier document shares has
  a rare line, and all its holders meet, or has none, and its earliest holder is met. A run that n documents share makes n-1 pairs.
* Alignment. Lines that occur once in both, or once in both between two anchors, are the anchors; their longest increasing subsequence is
  kept; blocks grow from the anchors; what lies between is aligned likewise. An exact check follows: a shortest run of the later
  document that the earlier one has anywhere, moved or repeated, is a common block too. It is looked up by its lines' hashes.

So the result does not depend on which of several holders a document meets: a line goes if some earlier document has a block of at
least `min_words` words around it. Every block is the union of its shortest runs, and which runs there are depends on the run alone.

Only line hashes are shuffled to be aligned (64 bits to find pairs, 128 to compare). A task holds one earlier document and one later
one; the pairs of an earlier document that very many meet are dealt to several tasks of at most about `_PAIRS` pairs.

Defined results: lines end at a line feed; null text is the empty text, one empty line; empty lines never align and end a block; documents
without an id come after all others, by the hash of their text; rows that repeat an id and its text are one document and get the
same result. Empty in, empty out. Other columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import temporary, texts, written

MIN_WORDS, RARE = 10, 8
_PAIRS = 4096
_BLANKS = re.compile("[ \t]+")
_LINE = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("pos", "<i4"), ("words", "<i4")])
_WHO = "struct<none:int,id:long,th:long>"
_SPANS = "array<struct<first:int,last:int>>"


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (here, there), sorted by here, whose theres increase."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, there) in enumerate(pairs):
        k = bisect_left(tops, there)
        if k == len(tops):
            tops.append(there)
            at.append(i)
        else:
            tops[k], at[k] = there, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def shortest_runs(words: Sequence[int], min_words: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest runs of at least min_words words from each line on and up to each line; lines of 0 words end a run."""
    out: set[tuple[int, int]] = set()
    at = 0
    while at < len(words):
        end = at
        while end < len(words) and words[end]:
            end += 1
        first, total = at, 0
        for last in range(at, end):  # up to each line
            total += words[last]
            while total - words[first] >= min_words:
                total -= words[first]
                first += 1
            if total >= min_words:
                out.add((first, last))
        last, total = end - 1, 0
        for first in range(end - 1, at - 1, -1):  # from each line on
            total += words[first]
            while total - words[last] >= min_words:
                total -= words[last]
                last -= 1
            if total >= min_words:
                out.add((first, last))
        at = end + 1
    return out


class Lines:
    """One document's lines: `line[i]` identifies line i, None for an empty one; `words[i]` is its number of words, 0 for an empty one."""

    def __init__(self, line: list, words: list[int], min_words: int):
        self.line, self.words, self.min_words = line, words, min_words
        self._runs: set[tuple] | None = None

    @classmethod
    def unpacked(cls, packed: bytes, n: int, min_words: int) -> Lines:
        rows = np.frombuffer(packed, _LINE)
        line, words = [None] * n, [0] * n
        for a, b, i, w in rows.tolist():
            line[i], words[i] = (a, b), w
        return cls(line, words, min_words)

    def spans(self) -> set[tuple[int, int]]:
        return shortest_runs(self.words, self.min_words)

    @property
    def runs(self) -> set[tuple]:
        if self._runs is None:
            self._runs = {tuple(self.line[a : z + 1]) for a, z in self.spans()}
        return self._runs


def diff(early: Lines, later: Lines) -> list[tuple[int, int]]:
    """(here, there) of the lines that patience diff aligns, sorted."""
    here, there = later.line, early.line
    out: list[tuple[int, int]] = []
    todo = [(0, len(here), 0, len(there))]
    while todo:
        a, z, b, y = todo.pop()
        while a < z and b < y and here[a] is not None and here[a] == there[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < z and b < y and here[z - 1] is not None and here[z - 1] == there[y - 1]:
            z, y = z - 1, y - 1
            out.append((z, y))
        if a == z or b == y:
            continue
        mine, theirs = Counter(here[a:z]), Counter(there[b:y])
        where = {x: j for j, x in enumerate(there[b:y], b) if theirs[x] == 1}
        chain = patience([(i, where[x]) for i, x in enumerate(here[a:z], a) if x is not None and mine[x] == 1 and x in where])
        if chain:
            out += chain
            for (i, j), (k, m) in zip([(a - 1, b - 1), *chain], [*chain, (z, y)], strict=True):
                if k - i > 1 and m - j > 1:
                    todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def common(early: Lines, later: Lines) -> list[tuple[int, int]]:
    """(first, last) of the later document's lines in common blocks."""
    blocks: list[list[int]] = []
    last = None
    for i, j in diff(early, later):
        if last == (i - 1, j - 1):
            blocks[-1][1] = i
        else:
            blocks.append([i, i])
        last = (i, j)
    out = [(a, z) for a, z in blocks if sum(later.words[a : z + 1]) >= later.min_words]
    taken = np.zeros(len(later.line) + 1, np.int64)
    for a, z in out:
        taken[a : z + 1] = 1
    sums = np.cumsum(np.r_[0, taken])
    for a, z in sorted(later.spans()):
        if sums[z + 1] - sums[a] < z + 1 - a and tuple(later.line[a : z + 1]) in early.runs:
            out.append((a, z))
    return out


def _pack(text: str) -> tuple[int, bytes]:
    lines = text.split("\n")
    rows = np.empty(len(lines), _LINE)
    n = 0
    for i, x in enumerate(lines):
        if x:
            digest = xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))
            rows[n] = (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), i, len(_BLANKS.split(x.strip(" "))))
            n += 1
    return len(lines), rows[:n].tobytes()


def _pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        who, done, size, at = batch.column("who"), [], 0, 0
        for i, text in enumerate(batch.column("text"), 1):
            n, packed = _pack(text.as_py())
            done.append((n, packed, np.unique(np.frombuffer(packed, _LINE)["h1"]).tolist()))
            size += len(packed)
            if size > 8_000_000 or i == batch.num_rows:
                a, b, c = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([who.slice(at, i - at), pa.array(a, pa.int32()), pa.array(b, pa.binary()), pa.array(c, pa.list_(pa.int64()))], ["who", "n_lines", "packed", "h"])
                done, size, at = [], 0, i


def _who(doc_id, th):
    """A document's place in the order: those without an id last."""
    return F.struct(doc_id.isNull().cast("int").alias("none"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"), th.alias("th"))


def hashed(docs: DataFrame) -> DataFrame:
    """A row for each document: who, n_lines, packed (its lines' hashes, places and words), h (its distinct line hashes); written."""
    rows = texts(docs).select(_who(F.col("doc_id"), F.xxhash64("text")).alias("who"), "text")
    rows = rows.mapInArrow(_pack_task, f"who {_WHO}, n_lines int, packed binary, h array<long>")
    return written(rows.dropDuplicates(["who"]), "line-hashes")


def _frequent_runs(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Of each document the hashes of its shortest runs of frequent lines only."""
    for batch in batches:
        who, rows = batch.column("who"), []
        for at, (n, packed, frequent) in enumerate(zip(batch.column("n_lines").to_pylist(), batch.column("packed").to_pylist(), batch.column("frequent").to_pylist(), strict=True)):
            own = np.frombuffer(packed, _LINE)
            own = own[np.isin(own["h1"], np.array(frequent, np.int64))]
            lines = Lines.unpacked(own.tobytes(), n, min_words)
            rows += [(at, xxhash.xxh3_128_digest(np.array(run, np.int64).tobytes())) for run in lines.runs]
        if rows:
            at, run = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.binary()), who.take(pa.array(at))], ["run", "who"])


def pairs(own: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """Distinct (early, later) of documents that overlap, enough of them that every shared run has a holder that is earlier; written. own: of `hashed`."""
    posting = own.select("who", F.explode("h").alias("h"))
    shared = written(posting.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared-lines")
    # Joined from written tables and written, so that nothing behind it wants one line in one task and a hot line can be split.
    held = written(posting.join(shared, "h"), "line-holders")
    few = held.where(F.col("n") <= rare).groupBy("h").agg(F.array_sort(F.collect_list("who")).alias("holders"))
    few = few.select("holders", F.posexplode("holders").alias("i", "early")).select("early", F.explode(F.slice("holders", F.col("i") + 2, F.size("holders"))).alias("later"))
    frequent = held.where(F.col("n") > rare).groupBy("who").agg(F.collect_list("h").alias("frequent"))
    runs = own.select("who", "n_lines", "packed").join(frequent, "who")
    runs = written(runs.mapInArrow(lambda b: _frequent_runs(b, min_words), f"run binary, who {_WHO}"), "frequent-runs")
    owners = written(runs.groupBy("run").agg(F.min("who").alias("early"), F.max("who").alias("last")).where("early <> last").select("run", "early"), "run-owners")
    many = runs.join(owners, "run").where("who <> early").select("early", F.col("who").alias("later"))
    return written(few.unionByName(many).distinct(), "line-pairs")


def _align(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by earlier document and part, the earlier document itself (kind 0) before its later ones."""
    early = None
    for batch in batches:
        kinds, counts, whos = batch.column("kind").to_pylist(), batch.column("n_lines").to_pylist(), batch.column("who")
        at, spans = [], []
        for i, (kind, n, packed) in enumerate(zip(kinds, counts, batch.column("packed"), strict=True)):
            lines = Lines.unpacked(packed.as_py(), n, min_words)
            if kind == 0:
                early = lines
            elif found := common(early, lines):
                at.append(i)
                spans.append([{"first": a, "last": z} for a, z in found])
        if at:
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([whos.take(pa.array(at)), pa.array([counts[i] for i in at], pa.int32()), pa.array(spans, kind)], ["who", "n_lines", "spans"])


def alignments(own: DataFrame, found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(who, n_lines, spans): of each later document, the lines of blocks common with one earlier document. found: of `pairs`."""
    loads = written(found.groupBy("early").agg(F.count("*").alias("n")).where(F.col("n") > _PAIRS), "hot-documents")
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(_PAIRS)).cast("int"), F.lit(1))
    dealt = found.join(loads, "early", "left").select("early", "later", F.pmod(F.xxhash64("later"), parts).cast("int").alias("part"))
    lines = own.select("who", "n_lines", "packed")
    later = dealt.join(lines, F.col("later") == F.col("who")).select("early", "part", F.lit(1).alias("kind"), "who", "n_lines", "packed")
    early = dealt.select("early", "part").distinct().join(lines, F.col("early") == F.col("who")).select("early", "part", F.lit(0).alias("kind"), "who", "n_lines", "packed")
    rows = early.unionByName(later).repartition("early", "part").sortWithinPartitions("early", "part", "kind", "who")
    return rows.mapInArrow(lambda b: _align(b, min_words), f"who {_WHO}, n_lines int, spans {_SPANS}")


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = []
        for n, parts in zip(batch.column("n_lines").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            mask = np.zeros(n, bool)
            for spans in parts:
                for span in spans:
                    mask[span["first"] : span["last"] + 1] = True
            gone.append(mask.tolist())
        yield pa.RecordBatch.from_arrays([batch.column("who"), pa.array(gone, pa.list_(pa.bool_()))], ["who", "gone"])


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """(who, gone): for each document with common blocks, which of its lines go."""
    with temporary(docs.sparkSession):
        own = hashed(docs)
        spans = alignments(own, pairs(own, min_words, rare), min_words)
        spans = spans.groupBy("who").agg(F.max("n_lines").alias("n_lines"), F.collect_list("spans").alias("parts"))
        return written(spans.mapInArrow(_masks, f"who {_WHO}, gone array<boolean>"), "line-deletions", kept=True)


def dedup_blocks(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """One row per document: doc_id, text without the lines deleted, n_lines, n_deleted."""
    gone = deletions(docs, min_words, rare).hint("merge")
    rows = texts(docs).withColumn("who", _who(F.col("doc_id"), F.xxhash64("text"))).join(gone, "who", "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.get("gone", i)), "\n")
    none = F.col("gone").isNull()
    return rows.select("doc_id", F.when(none, F.col("text")).otherwise(left).alias("text"), F.size(lines).alias("n_lines"), F.when(none, 0).otherwise(F.size(F.filter("gone", lambda x: x))).alias("n_deleted"))

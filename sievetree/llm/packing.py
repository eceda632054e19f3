"""Harmonic packing of documents into sequences.

Harmonic packing deals lengths into classes (C/(k+1), C/k] and fills a bin of class k with exactly k items, class by class, with
no look at other classes: every worker packs its own rows, there is no shuffle, and a lost worker's rows are packed again alike.

A document over C tokens gives full sequences; what is left, n tokens of class k, lacks C - k*n tokens to fill its bin. If that is at most
`waste` of C, it goes into class k whole, as most short documents do. If not, it is cut: its first floor(C/(k+1)) tokens, the longest
piece of class k+1 and so nearly without waste, and the rest, for which the same is asked. The rest is less than n/k, so few cuts do.

When a worker's rows end, the pieces in bins that are not full, fewer than k of each class, are packed together, the longest first, each
into the fullest sequence that has room for it. So a worker holds less than C tokens of each class, and pads one or a few sequences more.

A document is its token ids and then the id `end`. Ids are those of the tokenizer file: its added tokens are cut out of the text
first, and its ranks, kept beside it, give the ids of what lies between through the package's own encoder, which is several times faster.

Defined results: null and empty texts are the id `end` alone; each row is packed, repeated rows and rows without an id too;
sequence ids are (partition, number), unique in one result; empty in, empty out. Other columns are never read.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .bpe_columns import _default_path, runs
from .common import texts

CAPACITY, END = 2048, 1
#: Share of a sequence that a class may leave empty before documents are cut to fit it.
WASTE = 1 / 32
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def class_of(n: int, capacity: int = CAPACITY) -> int:
    """k, for a length in (capacity/(k+1), capacity/k]."""
    return capacity // n


def cut(n: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Lengths of a document's pieces: full sequences, then what is left, whole or in parts that fit their classes."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        k = class_of(rest, capacity)
        piece = rest if capacity - k * rest <= waste * capacity else capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


class Bins:
    """Open bins of one worker. put() and close() return rows (doc_id, start, length, doc_tokens, sequence, offset, ids)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self, rows: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for i, s, n, t, ids in rows:
            out.append((i, s, n, t, self.next, at, ids))
            at += n
        self.next += 1
        return out

    def put(self, row: tuple) -> list[tuple]:
        k = class_of(row[2], self.capacity)
        rows = self.open.setdefault(k, [])
        rows.append(row)
        return self._sequence(self.open.pop(k)) if len(rows) == k else []

    def close(self) -> list[tuple]:
        """Best fit of what is left, longest first."""
        left = sorted((row for rows in self.open.values() for row in rows), key=lambda row: -row[2])
        self.open = {}
        bins: list[list[tuple]] = []
        room: list[tuple[int, int]] = []  # (tokens free, bin), sorted
        for row in left:
            at = bisect_left(room, (row[2], 0))
            if at < len(room):
                free, b = room.pop(at)
            else:
                free, b = self.capacity, len(bins)
                bins.append([])
            bins[b].append(row)
            insort(room, (free - row[2], b))
        return [row for rows in bins for row in self._sequence(rows)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


@lru_cache(2)
def added_tokens(path: str) -> dict[str, int]:
    """Of the tokenizer file beside the rank file; none where there is no such file."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if odd := [t["content"] for t in found if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
        raise ValueError(f"added tokens that take their surroundings are not supported: {odd}")
    return {t["content"]: t["id"] for t in found}


def encode(codec: bpe.Encoder, some: list[str], added: dict[str, int]) -> list[np.ndarray]:
    """Ids of each text; an added token is one id wherever it stands, the longest where several begin."""
    if not any(a in t for t in some for a in added):
        return codec.encode(some)
    apart = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    parts = [apart.split(t) for t in some]
    between = iter(codec.encode([p for x in parts for p in x[::2]]))
    return [np.concatenate([np.array([added[p]], "<u4") if k % 2 else next(between) for k, p in enumerate(x)]) for x in parts]


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, waste: float) -> Iterator[pa.RecordBatch]:
    codec, added = bpe.encoder(path), added_tokens(path)
    context = TaskContext.get()
    bins = Bins(capacity, (context.partitionId() if context else 0) << 40)
    tail = np.array([end], "<u4").tobytes()
    for doc_ids, some in runs(batches):
        out: list[tuple] = []
        for doc_id, tokens in zip(doc_ids.to_pylist(), encode(codec, some, added), strict=True):
            raw, n, at = tokens.tobytes() + tail, len(tokens) + 1, 0
            for size in cut(n, capacity, waste):
                out += bins.put((doc_id, at, size, n, raw[4 * at : 4 * (at + size)]))
                at += size
        if out:
            yield _batch(out)
    if out := bins.close():
        yield _batch(out)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, waste: float = WASTE) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    path = path or _default_path()
    return texts(docs).mapInArrow(lambda b: _pack(b, path, capacity, end, waste), SCHEMA)


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, length, padding and ids of each sequence, its pieces joined."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    power = F.expr("length & (length - 1)") == 0
    return rows.select("sequence_id", "length", F.when(power, F.lit(0)).otherwise(F.lit(capacity) - F.col("length")).cast("long").alias("padding"), ids.alias("ids"))


def digests(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

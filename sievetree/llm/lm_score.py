"""Scores documents with a gated recurrent language model (gru.py), beside a smoothed unigram score.

Counts: every training document is tokenised and every word counted, pre-aggregated in each task before the shuffle. The KNOWN
commonest words, a bounded list, are broadcast with the model; counts of all others stay in a table. The LEARNED commonest have a
learned softmax, all others belong to a tail class by their form and have their counted share of it.

Training: documents are dealt by hash to shards of about SHARD_TOKENS tokens (from MAX_SHARDS shards on, shards grow instead); each
shard learns from its documents, whole texts, starting at the model the counts give, and the shards' weights are averaged by tokens.
Shards and the order in them follow from the documents, so the weights are the same however many tasks and machines there are. Long
documents come early in their shard, so that they end with it. Counts, biases and recurrent weights are of every token of every
training document, so training grows with the corpus.

Scoring: every document, whole, the state carried from its first token to its end. Documents are encoded once and written as token
numbers; words outside the known list are beside them as (word, times) and meet the count table in a join; common words never go
through it, so no hot word is shuffled.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end for each document.

Defined results: null and empty texts are the end alone; each row has its own result, also repeated rows (in training each counts)
and rows without an id (the crc of the empty text: not held out); without training documents N is 0 and the base score 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import crc32_of_id, texts, written

LEARNED, KNOWN = 2048, 60_000
#: No word holds white space, so the end token can be written as a line feed.
END = b"\n"
FORMS = 18
SHARD_TOKENS, MAX_SHARDS, RUN_TOKENS = 3_000_000, 4096, 500_000
_FLUSH_WORDS, _FLUSH_TOKENS, _BLOCK = 200_000, 2_000_000, 8192


def tokens(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def form(word: bytes) -> int:
    """Tail class: last character (comma, full stop, other), ASCII or not, length (to 5, to 9, over)."""
    last = word[-1]
    return (0 if last == 44 else 1 if last == 46 else 2) * 6 + (0 if word.isascii() else 3) + (0 if len(word) <= 5 else 1 if len(word) <= 9 else 2)


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc32_of_id(doc_id), F.lit(7)) == 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flushed() -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(map(form, words)), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "form", "n"])

    for batch in batches:
        for text in batch.column("text"):
            counts.update(tokens(text.as_py()))
            if len(counts) >= _FLUSH_WORDS:
                yield flushed()
                counts.clear()
    if counts:
        yield flushed()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, form, c) of all training documents, written to the shared folder."""
    rows = texts(docs).where(~held_out(F.col("doc_id"))).select("text").mapInArrow(_count, "word binary, form int, n long")
    return written(rows.groupBy("word", "form").agg(F.sum("n").alias("c")), "word-counts")


class Vocabulary:
    """The known words, commonest first, with their counts, and the totals behind all scores. It is broadcast; its size is bounded by `known`."""

    def __init__(self, counts: DataFrame, learned: int, known: int):
        total = counts.groupBy("form").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
        self.n, self.v = sum(r.c for r in total), sum(r.v for r in total)
        # The known words are those over a count that at most `known` words reach; counts are binned by their logarithm to find it.
        level = F.floor(F.log2("c") * 16).cast("int")
        bins = sorted(((r.level, r.v) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("v")).collect()), reverse=True)
        least, reached = None, 0
        for at, v in bins:
            if reached + v > known:
                break
            least, reached = at, reached + v
        rows = counts.where(level >= least).collect() if least is not None else []
        rows.sort(key=lambda r: (-r.c, bytes(r.word)))
        self.words = [bytes(r.word) for r in rows]
        self.counts = np.array([r.c for r in rows], np.float64)
        self.forms = np.array([r.form for r in rows], np.int64)
        self.learned = learned
        head = np.zeros(learned)
        head[: len(rows)] = self.counts[:learned]
        self.head = head
        self.tail_c, self.tail_v = np.zeros(FORMS), np.zeros(FORMS)
        for r in total:
            self.tail_c[r.form], self.tail_v[r.form] = r.c, r.v
        np.subtract.at(self.tail_c, self.forms[:learned], self.counts[:learned])
        np.subtract.at(self.tail_v, self.forms[:learned], 1)

    def arrays(self) -> None:
        """By place: known words, then the tail classes for words not known."""
        k = len(self.words)
        self.place = dict(zip(self.words, range(k), strict=True))
        forms = np.r_[self.forms, np.arange(FORMS)]
        is_learned = np.arange(k + FORMS) < min(self.learned, k)
        self.token = np.where(is_learned, np.arange(k + FORMS), self.learned + forms).astype(np.int32)
        self.log_count = np.r_[np.log10(self.counts + 1), np.zeros(FORMS)]
        share = -np.log10(self.tail_c + self.tail_v + 1)[forms]
        self.inside = np.where(is_learned, 0.0, self.log_count + share)
        self.known = np.arange(k + FORMS) < k

    def look_up(self, words: list[bytes]) -> np.ndarray:
        if not hasattr(self, "place"):
            self.arrays()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        for i in np.flatnonzero(at < 0).tolist():
            at[i] = len(self.words) + form(words[i])
        return at


_ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, tokens binary, rare array<struct<word:binary,n:int>>"


def _encode(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    v = vocabulary.value
    smooth = math.log10(v.n + v.v + 1)
    first = TaskContext.get().partitionId() << 40
    held: list[tuple] = []
    size = 0

    def encoded() -> pa.RecordBatch:
        nonlocal first
        n = len(held)
        lengths = np.fromiter((len(r[2]) for r in held), np.int64, n)
        places = np.concatenate([r[2] for r in held])
        owner = np.repeat(np.arange(n), lengths)
        base = np.bincount(owner, v.log_count[places], n) - lengths * smooth
        known = np.bincount(owner, v.known[places], n).astype(np.int64)
        inside = np.bincount(owner, v.inside[places], n)
        ids = [v.token[r[2]].astype("<u2").tobytes() for r in held]
        words = pa.array(list(chain.from_iterable(r[3] for r in held)), pa.binary())
        times = pa.array(list(chain.from_iterable(r[3].values() for r in held)), pa.int32())
        offsets = np.r_[0, np.cumsum(np.fromiter((len(r[3]) for r in held), np.int64, n))].astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([words, times], ["word", "n"]))
        columns = [pa.array(np.arange(first, first + n)), pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.bool_()), pa.array(lengths), pa.array(known), pa.array(base), pa.array(inside), pa.array(ids, pa.binary()), rare]
        first += n
        return pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "tokens", "rare"])

    for batch in batches:
        for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
            words = tokens(text.as_py())
            places = v.look_up(words)
            held.append((doc_id, out, places, Counter(words[i] for i in np.flatnonzero(places >= len(v.words)).tolist())))
            size += len(words)
            if size >= _FLUSH_TOKENS:
                yield encoded()
                held, size = [], 0
    if held:
        yield encoded()


def encode(docs: DataFrame, shared) -> DataFrame:
    """Every document as token numbers of two bytes, with what its score takes from the counts alone, written to the shared folder; training and scoring read it, so words are looked up once."""
    rows = texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return written(rows.mapInArrow(lambda b: _encode(b, shared), _ENCODED), "encoded")


def _ids(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_buffer(), "<u2").astype(np.int32) for x in column)


def _train(batches: Iterator[pa.RecordBatch], learned_words: int, first) -> Iterator[pa.RecordBatch]:
    """The rows of one shard, in its order."""
    model, learned, run, size = gru.restore(first.value, learned_words, FORMS), 0, [], 0
    trainer, shard = gru.Trainer(model, learned_words), 0
    for batch in batches:
        if batch.num_rows:
            shard = batch.column("shard")[0].as_py()
        for ids in _ids(batch.column("tokens")):
            run.append(ids)
            size += min(len(ids), trainer.segment)
            if size >= RUN_TOKENS:
                learned += trainer.run(run)
                run, size = [], trainer.waits
    learned += trainer.run(run) + trainer.finish()
    if learned:
        weights = gru.flatten(model).astype("<f8") * learned
        salt = shard % 64
        parts = [weights[i : i + _BLOCK].tobytes() for i in range(0, len(weights), _BLOCK)]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([learned] * n, pa.int64()), pa.array(parts, pa.binary())], ["block", "salt", "n", "weights"])


def _sum_blocks(table: pa.Table) -> pa.Table:
    # In one order always, as sums of floating-point numbers depend on it.
    total = np.sum([np.frombuffer(x, "<f8") for x in sorted(table.column("weights").to_pylist())], axis=0)
    return pa.table({"block": table.column("block").slice(0, 1), "salt": table.column("salt").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def fit(encoded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The averaged weights, half a megabyte whatever the input. Sums go through salted groups first, so no task gathers all workers' weights."""
    first = gru.flatten(gru.start(vocabulary.head, vocabulary.tail_c))
    begin, learned = encoded.sparkSession.sparkContext.broadcast(first), vocabulary.learned
    schema = "block int, salt int, n long, weights binary"
    shards = max(1, min(MAX_SHARDS, math.ceil(vocabulary.n / SHARD_TOKENS)))
    steps = max(1.0, vocabulary.n / shards / gru.LANES)
    own = encoded.where(~F.col("held_out")).select("tokens", F.xxhash64("doc_id", "tokens").alias("h"), "n_tokens")
    early = F.greatest(F.lit(0.0), 1 - F.col("n_tokens") / steps)
    own = own.select("tokens", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), (F.pmod(F.xxhash64("h"), F.lit(1 << 30)) * early).alias("turn"), "h")
    own = own.repartitionById(shards, "shard").sortWithinPartitions("turn", "h").select("shard", "tokens")
    sums = own.mapInArrow(lambda b: _train(b, learned, begin), schema).groupBy("block", "salt").applyInArrow(_sum_blocks, schema).groupBy("block").applyInArrow(_sum_blocks, schema)
    blocks = sorted(sums.collect(), key=lambda r: r.block)
    if not blocks:
        return first
    return (np.concatenate([np.frombuffer(bytes(r.weights), "<f8") for r in blocks]) / blocks[0].n).astype("<f4")


def _score(batches: Iterator[pa.RecordBatch], learned: int, weights) -> Iterator[pa.RecordBatch]:
    model = gru.restore(weights.value, learned, FORMS)
    kept: list[pa.RecordBatch] = []
    run: list[np.ndarray] = []

    def scored() -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        model_part = gru.log_likelihood(model, run, learned) / math.log(10)
        names = [*rows.schema.names, "score"]
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(model_part + rows.column("inside").to_numpy())], names)

    size = 0
    for batch in batches:
        at, tokens_of = 0, batch.column("tokens")
        rest = batch.drop_columns(["tokens"])
        for i, ids in enumerate(_ids(tokens_of), 1):
            run.append(ids)
            size += len(ids)
            if size >= _FLUSH_TOKENS:
                kept.append(rest.slice(at, i - at))
                yield scored()
                kept, run, size, at = [], [], 0, i
        if at < batch.num_rows:
            kept.append(rest.slice(at))
    if run:
        yield scored()


def score(docs: DataFrame, learned: int = LEARNED, known: int = KNOWN) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Token numbers have two bytes, so `learned` is at most 65536 - FORMS."""
    if learned + FORMS > 1 << 16:
        raise ValueError("too many learned words for token numbers of two bytes")
    sc = docs.sparkSession.sparkContext
    counts = count_words(docs)
    vocabulary = Vocabulary(counts, learned, known)
    encoded = encode(docs, sc.broadcast(vocabulary))
    model = sc.broadcast(fit(encoded, vocabulary))
    rows = encoded.drop("rare").mapInArrow(lambda b: _score(b, learned, model), _ENCODED.replace(", tokens binary, rare array<struct<word:binary,n:int>>", ", score double"))
    rare = encoded.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n").join(counts.select("word", "c"), "word")
    rare = rare.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("also"))
    more = F.coalesce("more", F.lit(0.0))
    return rows.join(rare, "rid", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))

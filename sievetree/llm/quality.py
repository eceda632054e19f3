"""Quality classifier: supervised subword embeddings.

A text's features are its words, their character n-grams and its word 2-grams, hashed to buckets with a learned vector each. The text is
the average of its features' vectors, and a softmax over two classes sits on top. Training is stochastic gradient descent in numpy, one
text a step, in one task over a sample of labelled rows that is bounded by `max_train` (a documented parameter; the rows with the smallest
hash of their id); it holds a text as its buckets, at most BUCKETS of them however long it is. Scoring covers every text whole: as
everything behind the average is linear, a word has one number, the sum over its own features, which for words seen before comes from a
bounded cache, and a 2-gram has its bucket's.

Held-out labels are never learned from; labels, lang, source and doc_id are never inputs of a score.

Defined results: a text without words, so also a null one, scores what the bias says; repeated rows and rows without an id have
their own results; labels that are null or of unknown ids are ignored, and of an id labelled twice the smaller label counts; with
no labelled row, or one class only, the vectors stay as they start and the score says the share of label 1 (1/2 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, load, texts

BUCKETS, DIMENSIONS, GRAMS, EPOCHS, RATE, SEED = 1 << 17, 12, (3, 4, 5), 6, 1.0, 7
MAX_TRAIN, LEAST_STEPS = 4000, 20_000
_PRIME, _CACHE = np.uint64(0x100000001B3), 150_000
#: Bytes of words that are hashed at once, and characters of texts that are scored at once.
_CHUNK, _RUN = 120_000, 500_000


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 17)).astype(np.int64) % BUCKETS


def _chunks(words: list[bytes], most: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of words of at most so many bytes; a longer word is a run of its own. While it is hashed, a letter takes some hundred times its room."""
    begin = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) + 2 > most:
            yield begin, i
            begin, size = i, 0
        size += len(w) + 2
    if words:
        yield begin, len(words)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of a word by itself, the word and the n-grams of <word>, all words in one array; and each word's hash."""
    joined = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = (np.arange(len(joined)) - begins[owner]).astype(np.uint64)
    whole = np.add.reduceat((joined + np.uint64(1)) * (place * _PRIME + np.uint64(0x9E3779B97F4A7C15) ^ place << np.uint64(7)), begins)
    owners, hashes = [np.arange(len(words))], [whole]
    rolling = joined.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(joined) < n:
            break
        rolling = rolling[:-1] * _PRIME + joined[n - 1 :]
        if n in GRAMS:
            inside = owner[: len(rolling)] == owner[n - 1 :]
            owners.append(owner[: len(rolling)][inside])
            hashes.append(rolling[inside] + np.uint64(n))
    return np.concatenate(owners), _buckets(np.concatenate(hashes)), whole


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each word 2-gram, from the hashes of a row of words. A 2-gram's hash is the difference of its words' hashes: another one for each pair of words, also the other way round, but one for all words that follow themselves, so that repetition is learned from some words and known of others."""
    mixed = hashes[1:] - hashes[:-1]
    return _buckets(mixed ^ mixed >> np.uint64(31))


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares among its features."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    counts = np.zeros(BUCKETS, np.int64)
    own: dict[bytes, int] = {}
    at = np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words))
    times, distinct, hashes = np.bincount(at, minlength=len(own)), list(own), []
    for i, end in _chunks(distinct):
        owner, bucket, whole = word_features(distinct[i:end])
        np.add.at(counts, bucket, times[i:end][owner])
        hashes.append(whole)
    np.add.at(counts, pair_buckets(np.concatenate(hashes)[at]), 1)
    bucket = np.flatnonzero(counts)
    return bucket.astype(np.int32), (counts[bucket] / counts.sum()).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(the margin of class 1 over class 0 that a feature adds, by bucket, and without features). bags: a text's buckets, their shares, its label."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    top = np.zeros((2, DIMENSIONS), np.float32)
    positive = sum(y for *_, y in bags)
    share = min(max(positive / len(bags), 1e-3), 1 - 1e-3) if bags else 0.5
    bias = np.log(np.array([1 - share, share], np.float32))
    if 0 < positive < len(bags):
        epochs = max(epochs, -(-LEAST_STEPS // len(bags)))
        total = epochs * len(bags)
        for epoch in range(epochs):
            for k, i in enumerate(rng.permutation(len(bags))):
                bucket, part, y = bags[i]
                step = rate * (1 - (epoch * len(bags) + k) / total)
                own = vectors[bucket]
                hidden = part @ own
                logits = top @ hidden + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[y] -= 1
                back = p @ top
                top -= step * np.outer(p, hidden)
                bias -= step * 0.1 * p
                # A vector's share of the average is small; steps on vectors are per feature, as if each had the whole gradient.
                vectors[bucket] = own - step * np.sqrt(part)[:, None] * back
    margin = top[1] - top[0]
    return (vectors @ margin).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias = margins, bias
        self.place: dict[bytes, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def __call__(self, some: list[str]) -> np.ndarray:
        words = [t.encode("utf-8", "surrogatepass").split() for t in some]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for x in words for w in x]
        new = list(set(flat).difference(self.place))
        if len(self.place) + len(new) > _CACHE:
            self.place, self.sums, self.counts, self.hashes = {}, np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)
            new = list(set(flat))
        if new:
            self.place.update(zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True))
            sums, counts, hashes = [self.sums], [self.counts], [self.hashes]
            for i, end in _chunks(new):
                some = new[i:end]
                owner, bucket, whole = word_features(some)
                sums.append(np.bincount(owner, self.margins[bucket], len(some)))
                counts.append(np.bincount(owner, minlength=len(some)))
                hashes.append(whole)
            self.sums, self.counts, self.hashes = np.concatenate(sums), np.concatenate(counts), np.concatenate(hashes)
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[1:] == owner[:-1]
        pairs = self.margins[pair_buckets(self.hashes[at])[inside]]
        total = np.bincount(owner, self.sums[at], len(words)) + np.bincount(owner[1:][inside], pairs, len(words))
        n = np.bincount(owner, self.counts[at], len(words)) + np.maximum(lengths - 1, 0)
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.bias)))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for text, y, at in zip(batch.column("text"), batch.column("quality").to_pylist(), batch.column("ord").to_pylist(), strict=True):
            bucket, part = _bag(text.as_py())
            rows.append((at, bucket.tobytes(), part.tobytes(), y))
    rows.sort()
    margins, bias = train([(np.frombuffer(b, np.int32), np.frombuffer(p, np.float32), y) for _, b, p, y in rows])
    yield pa.RecordBatch.from_arrays([pa.array([margins.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["margins", "bias"])


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc32_of_id(doc_id), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[bytes, float]:
    """The model, half a megabyte whatever the input. The sample of labels is bounded by max_train, so it is small enough to broadcast; texts go from the scan to the one training task, never to the driver."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    own = own.withColumn("ord", F.xxhash64("doc_id", F.lit(SEED)))
    sample = own.orderBy("ord", "doc_id", "quality").limit(max_train).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("ord").alias("ord"))
    rows = texts(docs).join(F.broadcast(sample), "doc_id").select("text", "quality", "ord").repartition(1)
    model = rows.mapInArrow(_train_task, "margins binary, bias double").first()
    return (bytes(model.margins), model.bias) if model else (bytes(4 * BUCKETS), 0.0)


def _scores(arrays: Iterator[pa.Array], margins: bytes, bias: float) -> Iterator[pa.Array]:
    """The scores of each array of texts. Only a run of texts at a time is made Python strings and words."""
    scorer = Scorer(np.frombuffer(margins, "<f4"), bias)
    for array in arrays:
        out, run, size = [], [], 0
        for text in array:
            run.append(text.as_py() or "")
            size += len(run[-1])
            if size >= _RUN:
                out.append(scorer(run))
                run, size = [], 0
        if run:
            out.append(scorer(run))
        yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())


def scorer(margins: bytes, bias: float):
    """A function of a column of texts. Python gets the texts alone and gives numbers back: a row's other columns, and the text itself, don't go there and back."""

    @F.arrow_udf("double")
    def of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _scores(arrays, margins, bias)

    return lambda text: of(F.coalesce(text.cast("string"), F.lit("")))


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    margins, bias = fit(docs, labels, max_train)
    rows = texts(docs).select("doc_id", scorer(margins, bias)(F.col("text")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that score at least `least`, all columns as they are."""
    margins, bias = fit(docs, labels, max_train)
    return docs.where(scorer(margins, bias)(F.col("text")) >= least)


def query(spark, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir), load(spark, sf_dir, "labels"))

"""Byte-level BPE over DataFrames: encode, decode, and the round trip.

Defined results: a null text is the empty text, which has no tokens; each row has its own result, repeated rows and rows without an
id too; a text of any length is one unit, encoded whole, with memory in proportion to it; empty in, empty out. Other columns are
never read. The rank file's path is a parameter; every worker process reads it from the installed tokenizer package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import texts


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of about a million code points at a time."""
    for batch in batches:
        ids, all_texts, at = batch.column("doc_id"), batch.column("text").to_pylist(), 0
        for some in bpe.groups(all_texts):
            yield ids.slice(at, len(some)), some
            at += len(some)


def _encode(batches: Iterator[pa.RecordBatch], path: str, with_decoded: bool) -> Iterator[pa.RecordBatch]:
    codec = bpe.encoder(path)
    for ids, some in runs(batches):
        tokens = codec.encode(some)
        columns = {"doc_id": ids, "n_tokens": pa.array([len(t) for t in tokens], pa.int64()), "ids": pa.array([t.tobytes() for t in tokens], pa.binary())}
        if with_decoded:
            columns["decoded"] = pa.array(map(codec.decode, tokens), pa.binary())
        yield pa.RecordBatch.from_pydict(columns)


def encode(docs: DataFrame, path: str | None = None, with_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and on demand the bytes that the ids decode to."""
    path = path or _default_path()
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * with_decoded
    return texts(docs).mapInArrow(lambda b: _encode(b, path, with_decoded), schema)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = bpe.encoder(path)
    for batch in batches:
        tokens = [np.frombuffer(x.as_py() or b"", "<u4") for x in batch.column("ids")]
        offsets = pa.array([codec.offsets(t).tolist() for t in tokens], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(map(codec.decode, tokens), pa.binary()), "offsets": offsets})


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded (bytes), offsets (of each token in those bytes) of a table with doc_id and ids."""
    path = path or _default_path()
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decode(b, path), "doc_id long, decoded binary, offsets array<long>")

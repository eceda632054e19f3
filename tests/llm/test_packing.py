import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievetree.llm import bpe, packing, queries
from sievetree.llm.bpe_columns import _default_path
from sievetree.llm.common import load

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "no such token <|endoftext|", "", "tail\n <|endoftext|>"]


def test_added_tokens_as_the_tokenizer_file_has_them(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [whole.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert want[0] == [64, 220, 50256, 275]
    path = _default_path()
    assert [x.tolist() for x in packing.encode(bpe.encoder(path), TEXTS, packing.added_tokens(path))] == want
    pieces = packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    for i, ids in enumerate(want):
        own = sorted((r.start, bytes(r.ids)) for r in pieces if r.doc_id == i)
        assert b"".join(x for _, x in own) == b"".join(x.to_bytes(4, "little") for x in [*ids, packing.END])


def test_pieces_fit_their_classes():
    for capacity in (2048, 100, 7):
        for n in range(1, 3 * capacity):
            sizes = packing.cut(n, capacity)
            assert sum(sizes) == n and sizes[: n // capacity] == [capacity] * (n // capacity)
            for size in sizes:
                k = packing.class_of(size, capacity)
                assert capacity / (k + 1) < size <= capacity / k
            assert all(capacity - packing.class_of(s, capacity) * s <= max(packing.WASTE * capacity, packing.class_of(s, capacity)) for s in sizes)
    counts = [len(packing.cut(n)) for n in range(1, 2048)]
    assert sum(counts) / len(counts) < 3.5


def test_bins_of_a_class_take_its_number_of_pieces():
    bins, rng = packing.Bins(2048, 5), random.Random(3)
    rows, closed = [], []
    for i in range(3000):
        size = rng.choice([2048, 1000, 1020, 681, 500, 205, 30, 1, rng.randint(1, 2048)])
        rows += bins.put((i, 0, size, size, b""))
    closed = bins.close()
    own = {}
    for i, _, n, _, sequence, offset, _ in rows:
        own.setdefault(sequence, []).append((offset, n))
    for pieces in own.values():
        assert len({packing.class_of(n, 2048) for _, n in pieces}) == 1 and len(pieces) == packing.class_of(pieces[0][1], 2048)
    assert len(rows) + len(closed) == 3000 and not bins.open
    for _, _, n, _, sequence, offset, _ in closed:
        own.setdefault(sequence, []).append((offset, n))
    assert sorted(own) == list(range(5, 5 + len(own)))
    for pieces in own.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_query_against_the_tokenizer_file(spark):
    rows = queries.op7_packing(spark, "/root/testdata/sf0.001").collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = load(spark, "/root/testdata/sf0.001").collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {d.doc_id for d in docs}
    for d, coded in zip(docs, whole.encode_batch([d.text or "" for d in docs], add_special_tokens=False), strict=True):
        ids, at = np.array([*coded.ids, 1], "<u4"), 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.04 * total and len(rows) < 4 * len(docs)

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sievetree.llm import bpe, bpe_columns, packing, queries, token_counts

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def tools():
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.Encoder(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library(tools):
    codec, library = tools
    rng = random.Random(0)
    parts = [" ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "'", "'s", "'re", "r", "e", "l", "ve", "'ll", "'v", "'d", "m", "s", "t", "A", "é", "東", "1", "½", "٣", ".", "!!", "́", "\U0001f600", "\x00", "-", "<|endoftext|>", "word", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [t or "" for _, t in AWKWARD] + ["x" * 3000, "'" * 99, "ab" * 700, "\n" * 50]
    got = codec.encode(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(g) for g in got] == [t.encode() for t in texts]
    assert codec.count(texts) == [len(g) for g in got]
    assert codec.offsets(np.array(library.encode_ordinary(" the cat"), "<u4")).tolist() == [0, 4]


def test_every_code_point_class(tools):
    codec, library = tools
    texts = ["a" + c + " 1" + c + "." + c for c in map(chr, range(0, 0x30000, 7)) if not "\ud800" <= c <= "\udfff"]
    assert [g.tolist() for g in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_small_cache_and_plain_merge(tools):
    codec, library = tools
    small = bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), entries=5)
    texts = ["one two three four five six seven eight", "nine ten one two"]
    assert [g.tolist() for g in small.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    for piece in (b"antidisestablishmentarianism", b"\xff\xfe\x00", b" zzzz" * 9):
        assert list(bpe.merge(piece, codec.ranks)) == library._encode_single_piece(piece)


def test_scan_is_the_plain_automaton():
    rng = np.random.default_rng(0)
    of_class, table, functions = bpe.monoid()
    for n in (0, 1, 63, 64, 65, 5000):
        classes = rng.integers(0, 12, n)
        state, want = bpe.START, []
        for c in classes:
            state = bpe._next_state(state, c)
            want.append(state)
        assert functions[:, bpe.START][bpe.scan(of_class[classes], table)].tolist() == want


def test_columns(awkward, nothing, tools):
    rows = {r.ids: r for r in bpe_columns.encode(awkward, with_decoded=True).collect()}
    assert {bytes(r.decoded) for r in rows.values()} == {(t or "").encode() for _, t in AWKWARD}
    assert bpe_columns.encode(nothing).count() == 0
    back = bpe_columns.decode(bpe_columns.encode(awkward)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in AWKWARD)


def test_token_counts(awkward, nothing, tools):
    lengths = [len(tools[1].encode_ordinary(t or "")) for _, t in AWKWARD]
    hist = token_counts.histogram(awkward)
    rows = hist.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        n = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.docs_up_to, r.truncated_tokens, r.total_tokens) == (sum(x <= n for x in lengths), sum(min(x, n) for x in lengths), sum(lengths))
    for r in token_counts.limits(hist, [1, 10, 11, 10**6]).collect():
        assert (r.docs_at_least, r.truncated_tokens) == (sum(x >= r.context for x in lengths), sum(min(x, r.context) for x in lengths))
    for r in token_counts.quantiles(hist, [0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == min(x for x in lengths if sum(y <= x for y in lengths) >= r.share * len(lengths))
    assert token_counts.histogram(nothing).count() == 0
    assert token_counts.histogram(awkward, by=["lang"]).where("lang = 's'").count() == len(set(lengths))


def test_packing(awkward, nothing, tools):
    pieces = packing.pack(awkward).collect()
    want = sorted([*tools[1].encode_ordinary(t or ""), 1] for _, t in AWKWARD)
    lengths = {}
    for p in pieces:
        lengths.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length
    total = 0
    for rows in lengths.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048
        total += at
    assert total == sum(map(len, want))
    docs = {}
    for p in sorted(pieces, key=lambda p: p.start):
        docs.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for (doc_id, n), parts in docs.items():
        if (doc_id, n) != (7, parts[0].doc_tokens):
            ids = np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist()
            assert ids in want and [p.start for p in parts][0] == 0
    assert packing.pack(nothing).count() == 0
    assert packing.cut(0) == [] and packing.cut(5000) == [2048, 2048, 682, 222] and packing.cut(2030) == [2030]
    joined = packing.sequences(packing.pack(awkward)).collect()
    power = lambda n: n & (n - 1) == 0
    assert all(r.padding == (0 if power(r.length) else 2048 - r.length) and len(r.ids) == 4 * r.length for r in joined)


def test_the_query_digests_what_the_library_gives(tools, spark, tmp_path):
    rows = [*AWKWARD, (20, "<|endoftext|> it's 12 o'clock, Größe   東京\n\n"), (21, "퟿ x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op10_bpe(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, text in rows:
        ids = tools[1].encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)

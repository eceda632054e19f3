import hashlib
import random
import re

from pyspark.sql import functions as F

from sievetree.llm import exact_dedup

from .conftest import AWKWARD


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        same = [(-len(u or ""), j is None, j or 0, j) for (j, u), m in zip(rows, norm, strict=True) if m == n]
        keep = min(same)[3]
        out.append((i, keep, len(same), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(awkward):
    for capacity in (1, 2048):
        assert sorted(map(tuple, exact_dedup.groups(awkward, capacity).collect()), key=repr) == brute(AWKWARD)


def test_hot_group_and_directory(spark):
    rows = [(i, "one text" if i % 3 else f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.groups(docs, 8).collect()), key=repr) == brute(rows)
    found = exact_dedup.directory(exact_dedup.postings(docs).select("key").distinct(), 8).collect()
    assert all(0 < r.local_depth and r.bucket < 2**r.local_depth for r in found)
    assert len({(r.local_depth, r.bucket) for r in found}) > 8


def test_empty_and_dedup(awkward, nothing):
    assert exact_dedup.groups(nothing).count() == 0
    kept = exact_dedup.dedup(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 5, 7, 8, 9, 10, 11]


def narrow(norm):
    """Three keys for all texts, so that chains are long."""
    return F.pmod(F.xxhash64(norm), F.lit(3))


def test_texts_under_one_key_are_told_apart_by_their_bytes(spark, monkeypatch):
    rows = [(i, f"text {i // 3}{' ' * (i % 2)}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda hot: sorted(map(tuple, exact_dedup.groups(docs, 1, key=narrow, hot=hot).collect()), key=repr)
    assert got(256) == got(5) == brute(rows)
    monkeypatch.setattr(exact_dedup, "chained", lambda rows: rows.withColumn("chain", F.lit(1)))
    assert got(256) != brute(rows)


def test_hot_keys_are_counted_before_they_move(spark):
    rows = [(i, "one  text" if i % 3 else f"text {i}") for i in range(900)] + [(None, "onetext")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    post = exact_dedup.postings(docs)
    index = exact_dedup.build_index(docs, post, 16)
    assert [(r.doc_id, r.group_size, r.keep_id) for r in index.where("counted").collect()] == [(None, 601, 1)]
    assert index.count() == 301
    assert sorted(map(tuple, exact_dedup.groups(docs, 16).collect()), key=repr) == brute(rows)


def test_the_directory_splits_until_buckets_fit(spark):
    rng = random.Random(9)
    keys = sorted({rng.getrandbits(64) - 2**63 for _ in range(3000)} | {k + 2**40 for k in range(40)})
    for capacity in (1, 7, 500, 5000):
        cells = exact_dedup.directory(spark.createDataFrame([(k,) for k in keys], "key long"), capacity).collect()
        bits = lambda k, d: (k % 2**64) >> (64 - d)
        for r in cells:
            own = sum(bits(k, r.local_depth) == r.bucket for k in keys)
            assert own == r.n <= capacity
            if r.local_depth:
                assert sum(bits(k, r.local_depth - 1) == r.bucket >> 1 for k in keys) > capacity
        assert sum(r.n for r in cells) == len(keys)


def test_no_python_and_texts_move_once(awkward, nothing):
    plan = exact_dedup.groups(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
    names = [f"`{c}`" for c in ("__id", "__sha", "row", "id", "sha", "key", "n")]
    wide = awkward.selectExpr("doc_id", "text", *[f"1 as {c}" for c in names])
    assert exact_dedup.dedup(wide).columns == wide.columns
    assert exact_dedup.dedup(wide).count() == exact_dedup.dedup(awkward).count()

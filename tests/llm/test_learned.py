"""The quality classifier and the language model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sievetree.llm import gru, lm_score, quality

from .conftest import AWKWARD


def corpus(n=240):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        good = i % 3 != 0
        words = [rng.choice(["river", "stone", "cloud", "meadow"]) if good else rng.choice(["win$$$", "click!!", "###", "buy%%"]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_quality_on_held_out_rows(spark, awkward, nothing):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}  # held-out labels are wrong on purpose: they must not matter
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == y and 0 <= got[i].score <= 1 for i, _, y in rows)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, y in rows if y}
    scores = quality.score(awkward, labels).collect()
    assert len(scores) == len(AWKWARD) and len({r.score for r in scores if r.doc_id in (3, 4, 5)}) == 1
    assert quality.score(nothing, labels).count() == 0
    none = quality.score(docs, labels.where("false")).collect()
    assert all(r.score == 0.5 for r in none)


def test_scorer_is_the_average():
    margins = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    scorer = quality.Scorer(margins, 0.25)
    texts = ["a a b", "", "größe größe 東京 x", "one " * 500]
    for t, s in zip(texts, scorer(texts), strict=True):
        bucket, share = quality._bag(t)
        assert abs(s - 1 / (1 + math.exp(-(float(margins[bucket].astype(float) @ share) + 0.25)))) < 1e-5


def test_every_word_pair_is_a_feature():
    """Texts that differ in the order of their words only are told apart."""
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        words = [rng.choice(["red", "green", "blue"]) for _ in range(12)]
        for y in (0, 1):
            rows.append((" ".join(f"{w} {'of it' if y else 'it of'}" for w in words), y))
    bags = [(*quality._bag(t), y) for t, y in rows]
    scorer = quality.Scorer(*quality.train(bags[:400]))
    assert np.mean((scorer([t for t, _ in rows[400:]]) >= 0.5) == [y for _, y in rows[400:]]) > 0.95
    bucket, share = quality._bag("a b c a b")
    assert abs(share.sum() - 1) < 1e-6 and len(quality.pair_buckets(np.arange(5, dtype=np.uint64))) == 4


def test_gradients():
    rng = np.random.default_rng(0)
    model = gru.start(rng.integers(1, 50, 128).astype(float), np.arange(1, 4.0))
    for p in ("uc", "uw"):
        model[p] = rng.normal(0, 0.3, model[p].shape).astype(np.float32)
    words = rng.integers(0, 131, 7).astype(np.int32)
    total = 0.0  # all tokens' probabilities add up to one at each step
    for t in range(131):
        total += math.exp(gru.log_likelihood(model, [np.array([t], np.int32)], 128)[0])
    assert abs(total - 1) < 1e-4
    whole = gru.log_likelihood(model, [words, words[:3]], 128, window=2)
    assert np.allclose(whole, gru.log_likelihood(model, [words, words[:3]], 128, width=1, window=100), atol=1e-4)
    before = gru.log_likelihood(model, [words] * 4, 128).sum()
    for _ in range(5):
        gru.train(model, [words] * 4, 128)
    assert gru.log_likelihood(model, [words] * 4, 128).sum() > before


def slow_score(model, tokens, words):
    """The recurrence and both softmaxes of one text, a token and a number at a time, in double precision."""
    size = gru.HIDDEN
    m = {p: model[p].astype(float) for p in gru.PARTS}
    h, last, total = [0.0] * size, -1, 0.0
    for t in tokens:
        x = m["x"][last]
        g = [sum(h[i] * m["u"][i, j] for i in range(size)) for j in range(3 * size)]
        z = [1 / (1 + math.exp(-(x[j] + g[j]))) for j in range(size)]
        r = [1 / (1 + math.exp(-(x[size + j] + g[size + j]))) for j in range(size)]
        n = [math.tanh(x[2 * size + j] + r[j] * g[2 * size + j]) for j in range(size)]
        h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(size)]
        own = t // gru.CLASS if t < words else words // gru.CLASS + t - words
        logits = [m["bc"][c] + sum(h[i] * m["uc"][i, c] for i in range(size)) for c in range(len(m["bc"]))]
        total += logits[own] - math.log(sum(map(math.exp, logits)))
        if t < words:
            logits = [m["bw"][own, k] + sum(h[i] * m["uw"][own, i, k] for i in range(size)) for k in range(gru.CLASS)]
            total += logits[t % gru.CLASS] - math.log(sum(map(math.exp, logits)))
        last = t
    return total


def test_scores_are_the_recurrence():
    rng = np.random.default_rng(12)
    model = gru.start(rng.integers(1, 50, 128).astype(float), np.arange(1, 4.0))
    texts = [rng.integers(0, 131, k).astype(np.int32) for k in (1, 2, 17, 40, 130)]
    gru.train(model, texts * 20, 128)
    got = gru.log_likelihood(model, texts, 128, width=3, window=16)
    assert np.allclose(got, [slow_score(model, t.tolist(), 128) for t in texts], rtol=1e-4)


def test_segments_hold_every_token():
    whole = [np.arange(10, dtype=np.int32), np.arange(3, dtype=np.int32), np.arange(4, dtype=np.int32)]
    pieces, before = gru.segments(whole, 4)
    assert [p.tolist() for p in pieces] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [0, 1, 2], [0, 1, 2, 3]] and before.tolist() == [-1, 3, 7, -1, -1]
    model = gru.start(np.ones(128), np.ones(3))
    assert gru.train(model, whole, 128, segment=4) == 17


def test_lm_scores(spark, awkward, nothing):
    rows = [(i, t) for i, t, _ in corpus(60)] + AWKWARD
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i is None, i or 0, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, tokens, strict=True)))
    for known in (2, 60_000):  # nearly all words through the join, or none
        got = lm_score.score(docs, learned=64, known=known).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_score.score(nothing).count() == 0


def test_scoring_in_runs_is_scoring_at_once(monkeypatch):
    """Where a run of documents ends, also inside a batch, does not change scores or lose rows; a vocabulary beyond two bytes is refused."""
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(6)
    ids = [rng.integers(0, 64 + lm_score.FORMS, k).astype("<u2") for k in (1, 40, 3, 90, 7, 1, 25)]
    weights = SimpleNamespace(value=gru.flatten(gru.start(np.ones(64), np.ones(lm_score.FORMS))))
    batch = pa.record_batch({"rid": pa.array(range(7)), "inside": pa.array([-1.0 * k for k in range(7)]), "tokens": pa.array([x.tobytes() for x in ids], pa.binary())})
    found = []
    for most in (10**9, 50):
        monkeypatch.setattr(lm_score, "_FLUSH_TOKENS", most)
        out = pa.Table.from_batches(lm_score._score(iter([batch.slice(0, 4), batch.slice(4)]), 64, weights))
        assert out.column("rid").to_pylist() == list(range(7))
        found.append(out.column("score").to_numpy())
    assert np.allclose(found[0], found[1], atol=1e-4)
    with pytest.raises(ValueError):
        lm_score.score(None, learned=1 << 16)


def test_training_carries_the_state_through_a_long_text():
    """Cut at every 5 tokens, a text learns as it does whole, but for the windows, which end at the cuts: with windows of 5 nothing differs."""
    rng = np.random.default_rng(3)
    long = rng.integers(0, 131, 40).astype(np.int32)
    models = []
    for segment in (5, 1000):
        model = gru.start(rng.integers(1, 2, 128).astype(float), np.ones(3))
        model["uc"] += np.random.default_rng(4).normal(0, 0.3, model["uc"].shape).astype(np.float32)
        trainer = gru.Trainer(model, 128, width=1, window=5, segment=segment)
        states = []
        trainer._learn = lambda *a, t=trainer, s=states: (lambda r: (s.append(r[1]), r)[1])(gru._learn(t.model, *a, t.words, t.width, t.window, 0.0))
        assert trainer.run([long]) + trainer.finish() == 40
        models.append(states)
    # With no steps taken the states behind the pieces are those of the recurrence over the whole text.
    model = gru.start(np.ones(128), np.ones(3))
    model["uc"] += np.random.default_rng(4).normal(0, 0.3, model["uc"].shape).astype(np.float32)
    h = np.zeros((1, gru.HIDDEN), np.float32)
    want = []
    for i, t in enumerate(np.r_[-1, long[:-1]]):
        h = gru._step(model, h, model["x"][[t]])[0]
        if i % 5 == 4:
            want.append(h[0].copy())
    assert np.allclose([s[0] for s in models[0][:-1]], want[:-1], atol=1e-6)


def test_texts_of_all_lengths_are_learned_from_once():
    rng = np.random.default_rng(8)
    model = gru.start(np.ones(128), np.ones(3))
    trainer = gru.Trainer(model, 128, width=4, window=4, segment=8)
    texts = [rng.integers(0, 131, n).astype(np.int32) for n in (1, 8, 9, 100, 16, 3, 50)]
    learned = trainer.run(texts[:4])
    assert len(trainer.waiting) == 2 and trainer.waits == 1 + 8
    learned += trainer.run(texts[4:]) + trainer.finish()
    assert learned == sum(map(len, texts)) and trainer.run([]) == 0


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(120)], "doc_id long, text string")
    scores = [{r.doc_id: r.score for r in lm_score.score(docs.repartition(k), learned=64).collect()} for k in (1, 7)]
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-6 * abs(scores[0][i]) for i in scores[0])


def test_repetition_is_known_of_words_never_seen():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(250):
        rows.append((" ".join(word() for _ in range(40)), 1))
        rows.append((" ".join([word() for _ in range(10)] + [word()] * 30), 0))
    scorer = quality.Scorer(*quality.train([(*quality._bag(t), y) for t, y in rows[:300]]))
    assert np.mean((scorer([t for t, _ in rows[300:]]) >= 0.5) == [y for _, y in rows[300:]]) > 0.97
    pairs = quality.pair_buckets(np.array([5, 5, 9, 5, 9, 9], np.uint64))
    assert pairs[0] == pairs[4] and pairs[1] != pairs[2]


def test_python_gets_the_texts_alone(spark):
    """Rows are kept with columns that no Arrow batch could hold."""
    rows = corpus(90)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("doc_id", "text", "make_interval(0, 1, 0, doc_id) as age")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    kept = quality.keep(docs, labels)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.selectExpr("doc_id", "cast(age as string) as age").collect()) == [i for i, _, y in rows if y]


def test_words_hashed_at_once_are_bounded_by_bytes(monkeypatch):
    rng = random.Random(2)
    long = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 6000]))) for _ in range(300)]
    margins = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    sizes, real = [], quality.word_features
    monkeypatch.setattr(quality, "word_features", lambda words: (sizes.append(sum(map(len, words))), real(words))[1])
    score = quality.Scorer(margins, 0.25)([" ".join(long)])[0]
    bucket, share = quality._bag(" ".join(long))
    assert max(sizes) <= 120_000 and sum(sizes) == 2 * sum(map(len, set(long)))
    assert abs(score - 1 / (1 + math.exp(-(float(margins[bucket].astype(float) @ share) + 0.25)))) < 1e-5
    assert list(quality._chunks([b"x" * 10, b"y", b"z" * 500, b"a"], 20)) == [(0, 2), (2, 3), (3, 4)] and not list(quality._chunks([]))

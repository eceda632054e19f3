import random
from itertools import combinations

import corpus_pipeline
from sievetree.llm import common, simhash, similar

from .conftest import AWKWARD


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """Smallest id of each row's component, over all pairs of exact similarity 4/5 or more."""
    sets = {i: plain(t) for i, t in rows if i is not None}
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    linked = 0
    for i, j in combinations(sorted(sets), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            linked += sets[i] != sets[j]
            a, b = sorted((find(i), find(j)))
            low[b] = a
    return {i: find(i) for i in low}, linked


def planted():
    """Originals, copies with words changed so that similarities lie on both sides of 0.8, chains of them, and a passage in half of all."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    texts = []
    for k in range(60):
        text = rng.choices(words, k=rng.randint(1, 160)) + passage * (k % 2)
        texts.append(text)
        for _ in range(rng.randint(0, 4)):
            text = list(text)
            for _ in range(rng.randint(0, 1 + len(text) // 40)):
                text[rng.randrange(len(text))] = rng.choice(words).upper()
            texts.append(text)
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]


def test_against_all_pairs(spark):
    rows = planted()
    want, linked = brute(rows)
    assert linked > 30 and 1 < len(set(want.values())) < len(rows)
    got = similar.copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_the_stage_finds_what_a_tight_fingerprint_radius_loses(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.no_near_copies(spark, docs, "").collect()}
    assert kept == set(brute(rows)[0].values())


def test_awkward(awkward, nothing):
    want, _ = brute([(i, t) for i, t in AWKWARD])
    kept = similar.dedup(awkward).select("doc_id", "text").collect()
    assert similar.dedup(awkward).columns == awkward.columns
    assert sorted((tuple(r) for r in kept), key=repr) == sorted(((i, t) for i, t in AWKWARD if i is None or want[i] == i), key=repr)
    assert similar.dedup(nothing).count() == 0


def test_near_dedup_bounds_what_goes_to_the_driver_and_to_python(spark, tmp_path, monkeypatch):
    """No join of tables of more rows than FEW sends one to every task, and batches for Python are small; the session's settings come back."""
    plans, sizes, key = [], set(), "spark.sql.execution.arrow.maxBytesPerBatch"
    write = common.written

    def seen(df, *args, **kwargs):
        sizes.add(spark.conf.get(key))
        out = write(df, *args, **kwargs)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    rows = planted()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, before = spark.read.parquet(str(tmp_path / "docs")), spark.conf.get(key)
    for module in (similar, simhash):
        monkeypatch.setattr(module, "written", seen)
    monkeypatch.setattr(common, "FEW", 0)
    got = {r.doc_id for r in similar.dedup(docs).collect()}
    assert got == {i for i, low in brute(rows)[0].items() if i == low}
    assert plans and not any("BroadcastExchange" in p for p in plans)
    assert sizes == {"4m"} and spark.conf.get(key) == before

import random

import pytest

from sievetree.llm import line_dedup

from .conftest import AWKWARD

LONG = [f"line number {i} has quite a few words in it to be counted" for i in range(12)]


def plain_lis(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if pairs[j][1] < pairs[i][1]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_patience():
    rng = random.Random(2)
    for _ in range(200):
        theres = rng.sample(range(40), rng.randint(0, 15))
        pairs = list(enumerate(theres))
        got = line_dedup.patience(pairs)
        assert len(got) == plain_lis(pairs) and got == sorted(got) and [t for _, t in got] == sorted(t for _, t in got)


def of(text, least=10):
    lines = text.split("\n")
    return line_dedup.Lines([x or None for x in lines], [len(x.split()) for x in lines], least)


def test_diff_is_an_alignment():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("\n".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))) for _ in range(2))
        found = line_dedup.diff(of(a), of(b))
        assert all(b.split("\n")[i] == a.split("\n")[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))
    found = line_dedup.diff(of("a\nx\ny\nb\nz"), of("a\nq\nx\nb\nw"))
    assert found == [(0, 0), (2, 1), (3, 3)]


def reference_diff(early, later):
    """Patience diff written anew: recursion on unique lines, with a quadratic longest increasing subsequence."""

    def solve(a, z, b, y):
        mine, theirs = later[a:z], early[b:y]
        unique = [(i, b + theirs.index(x)) for i, x in enumerate(mine, a) if x and mine.count(x) == 1 and theirs.count(x) == 1]
        best = [(1, -1)] * len(unique)
        for i in range(len(unique)):
            for j in range(i):
                if unique[j][1] < unique[i][1] and best[j][0] + 1 > best[i][0]:
                    best[i] = (best[j][0] + 1, j)
        if not unique:
            return set()
        i, chain = max(range(len(unique)), key=lambda k: best[k][0]), []
        while i >= 0:
            chain.append(unique[i])
            i = best[i][1]
        out = set(chain)
        for (i, j), (k, m) in zip([(a - 1, b - 1), *chain[::-1]], [*chain[::-1], (z, y)]):
            out |= solve(i + 1, k, j + 1, m)
        return out

    return sorted(solve(0, len(later), 0, len(early)))


def all_pairs_patience(rows, least):
    """Lines of each document in blocks of at least `least` words that patience diff aligns with any one earlier document."""
    docs = sorted((i, (t or "").split("\n")) for i, t in rows)
    out = {}
    for k, (i, lines) in enumerate(docs):
        gone = out.setdefault(i, set())
        for _, other in docs[:k]:
            block = []
            for pair in [*reference_diff(other, lines), (-9, -9)]:
                if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
                    if sum(len(lines[h].split()) for h, _ in block) >= least:
                        gone |= {h for h, _ in block}
                    block = []
                block.append(pair)
    return out


@pytest.mark.parametrize(("rare", "least"), [(8, 10), (1, 10), (2, 14), (100, 10), (8, 1)])
def test_no_line_that_all_pairs_of_documents_align_is_missed(spark, rare, least):
    rng = random.Random(4)
    rows = [(1, "\n".join(LONG)), (2, "mine\n" + "\n".join(LONG[3:7]) + "\nmine too"), (3, "\n".join(LONG[::-1])), (4, "short\nshort"), (5, "short\nother"), (6, None), (7, "")]
    rows += [(i, "\n".join(rng.choice([*LONG, "x", "y z", f"own {i}", "five words are in here"]) for _ in range(rng.randint(1, 30)))) for i in range(8, 60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pos int")
    got = {r.who.id: {k for k, x in enumerate(r.gone) if x} for r in line_dedup.deletions(docs, least, rare).collect()}
    want = all_pairs_patience(rows, least)
    assert sum(map(len, want.values())) > 100
    assert all(gone <= got.get(i, set()) for i, gone in want.items())
    texts = {r.doc_id: r.text for r in line_dedup.dedup_blocks(docs, least, rare).collect()}
    assert texts[1] == "\n".join(LONG)
    assert least == 1 or (texts[2] == "mine\nmine too" and texts[5] == "short\nother")


def test_pairs_do_not_grow_with_the_square(spark):
    """A passage of 400 documents makes a pair for each but the first, whatever its lines."""
    block = "\n".join(LONG[:3])
    rows = [(i, f"head {i}\n{block}\ntail {i}") for i in range(400)]
    own = line_dedup.hashed(spark.createDataFrame(rows, "doc_id long, text string"))
    found = line_dedup.pairs(own).collect()
    assert len(found) == 399 and {r.early.id for r in found} == {0}


def test_hot_documents_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_PAIRS", 16)
    block = "\n".join(LONG[:3])
    docs = spark.createDataFrame([(i, f"head {i}\n{block}") for i in range(200)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in line_dedup.dedup_blocks(docs).collect()}
    assert texts == {i: f"head {i}" if i else f"head 0\n{block}" for i in range(200)}


def test_awkward(awkward, nothing):
    rows = line_dedup.dedup_blocks(awkward, 1).collect()
    assert len(rows) == len(AWKWARD) and sorted(r.doc_id or 0 for r in rows) == sorted(i or 0 for i, _ in AWKWARD)
    assert [r.text for r in rows if r.doc_id == 1] == [AWKWARD[0][1]]
    assert line_dedup.dedup_blocks(nothing).count() == 0


def test_a_long_text_of_many_equal_lines(spark):
    text = "\n".join(["the same line of six words", "and another one of six words"] * 3000)
    rows = [(1, text), (2, f"{text}\nmine"), (3, "the same line of six words\nmine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_blocks(docs).collect()}
    assert got == {1: text, 2: "mine", 3: rows[2][1]}

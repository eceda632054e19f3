import random

from sievetree.llm import line_dedup

from .conftest import AWKWARD


def brute(rows, least=10):
    """Every later document against every earlier one: all maximal runs of equal neighbouring lines, wherever they stand."""
    docs = sorted((i, (t or "").split("\n")) for i, t in rows)
    out = {}
    for k, (i, lines) in enumerate(docs):
        gone = set()
        for _, other in docs[:k]:
            for h in range(len(lines)):
                for t in range(len(other)):
                    n = 0
                    while h + n < len(lines) and t + n < len(other) and lines[h + n] and lines[h + n] == other[t + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[h : h + n]) >= least:
                        gone |= set(range(h, h + n))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def got(spark, rows):
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pos int")
    return {r.doc_id: r.text for r in line_dedup.dedup_blocks(frame).collect()}


def nine(k):
    return f"{k} " + " ".join(f"w{k}{j}" for j in range(8))


def test_a_block_whose_lines_first_occur_in_different_documents(spark):
    block = "\n".join(map(nine, "abc"))
    rows = [(1, nine("a")), (2, nine("b")), (3, nine("c")), (4, f"mine\n{block}"), (5, f"{block}\nother")]
    assert got(spark, rows) == {1: nine("a"), 2: nine("b"), 3: nine("c"), 4: f"mine\n{block}", 5: "other"}


def test_passages_that_either_document_repeats(spark):
    block = "\n".join(map(nine, "abc"))
    rows = [(1, f"{block}\nx\n{block}"), (2, f"p\n{block}\nq"), (3, f"{block}\ny\n{block}")]
    assert got(spark, rows) == {1: rows[0][1], 2: "p\nq", 3: "y"}


def test_against_all_earlier_documents(spark):
    rng = random.Random(8)
    lines = ["", *[" ".join(f"v{k}{j}" for j in range(rng.choice([1, 2, 3, 4, 6, 9, 12]))) for k in range(14)]]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 25)))) for i in range(60)]
    want = brute(rows)
    assert sum(want[i] != t for i, t in rows) > 20
    assert got(spark, rows) == want


def test_awkward(awkward, nothing):
    rows = line_dedup.dedup_blocks(awkward, 1).collect()
    assert len(rows) == len(AWKWARD) and [r.text for r in rows if r.doc_id == 1] == [AWKWARD[0][1]]
    assert line_dedup.dedup_blocks(nothing).count() == 0

import random

import numpy as np
import pytest
import xxhash

from sievetree.llm import simhash
from sievetree.llm.common import written

from .conftest import AWKWARD


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain(t) for _, t in rows]
    seen, comp = set(), {}
    for p in set(prints):
        if p in seen:
            continue
        todo, group = [p], set()
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in set(prints) - group if (x ^ y).bit_count() <= 3]
        seen |= group
        ids = [i for (i, _), q in zip(rows, prints, strict=True) if q in group and i is not None]
        comp |= dict.fromkeys(group, min(ids, default=None))
    return sorted(((i, f"{p:016x}", comp[p]) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def test_fingerprint_in_parts():
    text = " ".join(f"w{i % 37} {i}" for i in range(500))
    assert simhash.fingerprint(text) == simhash.fingerprint(text, part=7) == plain(text)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, (2, 2000), np.uint64)
    ga, gb = simhash.embed(a), simhash.embed(b)
    want = [sum(abs((int(x) >> s & 3).bit_count() - (int(y) >> s & 3).bit_count()) for s in range(0, 64, 2)) for x, y in zip(a, b, strict=True)]
    assert simhash.manhattan(ga, gb).tolist() == want
    assert (simhash.manhattan(ga, gb) <= np.bitwise_count(a ^ b)).all()


def test_awkward_rows(awkward, nothing):
    assert sorted(map(tuple, simhash.near_duplicates(awkward).collect()), key=repr) == brute(AWKWARD)
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.dedup(awkward).columns == awkward.columns


@pytest.mark.parametrize("block", [3, 8192])
def test_chains_and_dense_groups(spark, block):
    """All links found whatever the block size, against all pairs."""
    rng = random.Random(1)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(9) for b in range(9)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    edges = simhash.links(frame, block)
    got = {tuple(r) for r in edges.collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in got)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    label = {simhash._signed(p): simhash._signed(p) for p in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                a, b = find(simhash._signed(p)), find(simhash._signed(q))
                label[max(a, b)] = min(a, b)
    assert all(roots.get(x, x) == find(x) for x in label)


def test_no_large_table_goes_to_the_driver(spark):
    """The join with the cells' sizes has 35 rows a fingerprint, whatever the size of the file that they come from."""
    rng = random.Random(5)
    frame = spark.createDataFrame([(simhash._signed(rng.getrandbits(64)),) for _ in range(3000)], "fp long")
    edges = simhash.links(written(frame, "prints"))
    edges.collect()
    assert "BroadcastExchange" not in edges._jdf.queryExecution().executedPlan().toString()

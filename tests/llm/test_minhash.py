"""SuperMinHash near-duplicates: signatures against their definition, groups against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from veldspan.llm import kernel as K
from veldspan.llm import minhash

SCHEMA = "doc_id long, text string, node string, label string, sketch string, size double"


def shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words)} if 0 < len(words) < 4 else {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def by_force(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), low.get(find(i)), r[0] == low.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def results(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", "y", "z", 1.0) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in minhash.near_duplicates(table, **more).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_signature_is_its_definition():
    """Every component holds the least of round + fraction over elements whose permutation has it in that round."""
    rng = np.random.default_rng(1)
    sizes = [1, 2, 3, 0, 17, 40, 200, 900]
    h = np.sort(rng.integers(0, 2**64, sum(sizes), dtype=np.uint64))
    rng.shuffle(h)
    o = np.concatenate([[0], np.cumsum(sizes)])
    got = minhash.signatures(h, o)
    for i in range(len(sizes)):
        want = np.full(minhash.M, minhash.EMPTY)
        for x in h[o[i] : o[i + 1]]:
            place = list(range(minhash.M))
            for j in range(minhash.M):
                k = j + int(K.mix(np.array([x ^ minhash._ROUND[minhash.M + j]]))[0] % np.uint64(minhash.M - j))
                place[j], place[k] = place[k], place[j]
                offer = (np.uint64(j) << np.uint64(56)) | (K.mix(np.array([x ^ minhash._ROUND[j]]))[0] >> np.uint64(8))
                want[place[j]] = min(want[place[j]], offer)
        assert (got[i] == want).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(200):
        n = int(rng.integers(5, 400))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = a.copy()
        b[: n // 9] = rng.integers(0, 2**64, n // 9, dtype=np.uint64)
        same = n - n // 9
        x, y = minhash.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        errors.append((x == y).mean() - same / (2 * n - same))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.036  # plain MinHash: 0.035 at 0.8


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d"), (6, "a b c d"), (6, "other words here now"), (None, "a b c d"), (None, "lone null"), (None, None)]


def test_edge_rows(spark):
    want = [(*x[:3], x[0] == x[2]) for x in by_force(EDGE)]
    assert results(spark, EDGE) == sorted(want, key=repr)
    assert results(spark, []) == []
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(7, long), (8, long + " tail"), (9, long[: len(long) // 2])]
    assert [r[2] for r in results(spark, rows)] == [7, 7, 9]


@pytest.mark.parametrize("group", [1024, 8])
def test_families(spark, group):
    """Families of near copies, a chain of links, and texts with a common passage that do not link, in small and in split groups."""
    random.seed(group)
    base = [[f"w{random.randint(0, 400)}" for _ in range(60)] for _ in range(4)]
    rows, n = [], 0
    for words in base:
        for _ in range(25):
            mine = list(words)
            for _ in range(random.choice([0, 1, 1, 2, 3, 5])):
                mine[random.randrange(60)] = f"x{random.randint(0, 99)}"
            rows.append((n := n + 1, " ".join(mine)))
    for i in range(20):  # each links with its neighbours only
        rows.append((n := n + 1, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 120))))
    for _ in range(40):
        rows.append((n := n + 1, " ".join(base[0] + [f"y{random.randint(0, 10**6)}" for _ in range(20)])))
    assert results(spark, rows, group=group) == by_force(rows)


def test_keeps_whole_rows(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (None, "z"), (3, None)]
    table = spark.createDataFrame([(*r, "x", "y", "z", 1.0) for r in rows], SCHEMA)
    kept = minhash.keep_one_of_each(table)
    assert kept.columns == table.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "3", "None"]

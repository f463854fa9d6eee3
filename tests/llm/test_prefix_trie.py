"""The prefix trie against a dictionary of all prefixes: edge rows, many segments, many ranges."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from veldspan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, parent string, depth string, digest binary"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, name, (role, text)))
    convs = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def by_force(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[x] for x in below)
    out = []
    for node, cs in members.items():
        ends = sorted(c for c in cs if len(sequences[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children.get(node, [])), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def results(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


EDGE = [
    (0, 0, "user", "hello"),
    (0, 1, "assistant", "hi there"),
    (0, None, None, None),
    (7, 0, "user", "hello"),
    (7, 0, "user", "hello"),
    (7, 0, "assistant", "tie"),
    (101, 3, "user", "no such base"),
    (-5, 0, "user", "negative"),
    (None, 0, "user", "no conversation"),
    (9, None, "user", "Ä" * 100_000),
    (300, 1, "user", ""),
    (300, 2, "", None),
    (301, 2, "", None),
]


@pytest.mark.parametrize("rows", [[], EDGE[:1], EDGE, [(None, 1, "a", "b")]], ids=["empty", "one", "edge", "none"])
def test_edge_rows(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA)
    assert results(prefix_trie.conversation_trie(table)) == by_force(rebuilt(rows))


def sequences_table(spark, sequences):
    rows = [(c, i, hashlib.md5(repr(t).encode()).digest(), len(t[1])) for c, turns in sequences.items() for i, t in enumerate(turns)]
    rows += [(c, None, None, 0) for c in sequences]
    return spark.createDataFrame(rows, "conv_id long, at long, digest binary, chars long")


@pytest.mark.parametrize("seed, size", [(1, 2), (2, 3), (3, 128), (4, 1)])
def test_random_tries(spark, seed, size):
    """Long common starts, copies, prefixes of others, ends at the borders of segments, several ranges an anchor."""
    random.seed(seed)
    pool = [[("r", "x" * random.randint(0, 9) + str(random.randint(0, 2))) for _ in range(12)] for _ in range(4)]
    sequences = {}
    for c in random.sample(range(1000), 150):
        start = random.choice(pool)[: random.choice([0, 0, 1, 2, 3, 4, 6, 8, 9, 12])]
        sequences[c] = start + [("r", random.choice("abc")) for _ in range(random.choice([0, 0, 1, 2, 3]))]
    got = results(prefix_trie.prefix_trie(sequences_table(spark, sequences), size))
    assert got == by_force(sequences)


def test_one_long_conversation(spark):
    sequences = {1: [("r", str(i % 5)) for i in range(300)], 2: [("r", str(i % 5)) for i in range(299)] + [("r", "z")], 3: [("r", "0")]}
    assert results(prefix_trie.prefix_trie(sequences_table(spark, sequences))) == by_force(sequences)


def test_ids_in_pieces(spark, monkeypatch):
    """Very many ends at one node are hashed piece by piece."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 100)
    ends = spark.range(5000).selectExpr("cast('n' AS binary) AS id", "id AS conv_id").union(spark.range(3).selectExpr("cast('m' AS binary)", "id"))
    got = {bytes(r.id): r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    want = {b"n": range(5000), b"m": range(3)}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}

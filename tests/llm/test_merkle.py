"""The Merkle manifest against a plain tree in Python: edge rows, several blocks and rounds."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from veldspan.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, _pos string, root string, leaf string"
LONG = "Very Long " * 50_000


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def beside(tree, i):
    out = []
    for level in tree[:-1]:
        a = i // 8 * 8
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return out


def by_force(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    groups = {k: sorted(v, key=lambda x: x[:3]) for k, v in groups.items()}
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in groups[k]]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    root, out = top[-1][0] if names else None, []
    for g, k in enumerate(names):
        for i, (_, _, own, row) in enumerate(groups[k]):
            path, text = beside(trees[k], i) + beside(top, g), row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(row, text)
            for left, right in path:
                folded = digest(left, folded, right)
            out.append((row[0], own, trees[k][-1][0], root, digest(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def results(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


EDGE = [
    (3, "a", "en", 5, "Hello"),
    (3, "a", "en", 5, "Hello"),
    (3, "b", "en", 5, "Hello"),
    (None, None, None, None, None),
    (None, "a", "en", 1, "X"),
    (7, "a", None, 1, "ÄB"),
    (-4, "", "", 0, ""),
    (9, "c", "de", 9, LONG),
    (10, "c", "e", 9, "1:x-"),
]


@pytest.mark.parametrize("rows", [[], EDGE[:1], EDGE, [(i, "s", "en", i, f"Text {i}") for i in range(65)]], ids=["empty", "one", "edge", "levels"])
def test_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", "z", None) for r in rows], SCHEMA)
    assert results(merkle.audit_documents(docs)) == by_force(rows)


def test_several_rounds(spark, monkeypatch):
    """With blocks of 8, 600 leaves of one group take four rounds and many groups two."""
    monkeypatch.setattr(merkle, "_LEVELS", merkle._LEVELS.replace("least(3,", "least(1,"))
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(merkle, "DEPTH", 1)
    rows = [(i, "s", "en" if i % 3 else f"l{i % 60}", i, f"Text {i}") for i in range(600)]
    docs = spark.createDataFrame([(*r, "x", "y", "z", None) for r in rows], SCHEMA)
    assert results(merkle.audit_documents(docs)) == by_force(rows)


def test_block_borders(spark):
    for n in (512, 513):
        rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
        docs = spark.createDataFrame([(*r, "x", "y", "z", None) for r in rows], SCHEMA)
        assert results(merkle.audit_documents(docs)) == by_force(rows)


def test_a_change_is_found(spark):
    docs = spark.createDataFrame([(i, "s", "en", i, f"text {i}", None, None, None, None) for i in range(30)], SCHEMA)
    assert all(r.verified for r in merkle.audit_documents(docs).collect())  # nothing to lower-case
    trees = merkle.manifest(merkle.leaves_of(docs))
    changed = merkle.manifest(merkle.leaves_of(docs.withColumn("text", merkle.F.when(merkle.F.col("doc_id") == 17, "other").otherwise(merkle.F.col("text")))))
    roots = [top.roots.first()["root"] for _, top in (trees, changed)]
    assert roots[0] != roots[1]

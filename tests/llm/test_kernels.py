"""Array primitives against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from veldspan.llm import decontamination as D
from veldspan.llm import kernel as K
from veldspan.llm import quality_classifier as Q
from veldspan.llm.quality_rules import base_counts
from veldspan.llm.suffix_array import common_prefixes, s_types, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|Z.", max_size=30)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_counts(texts, limit):
    column = pa.array(texts, pa.string())
    got = []
    for s in K.text_slices(column, limit=limit, max_rows=3):
        out, _ = base_counts(s)
        for i in range(s.hi - s.lo):
            got.append({k: int(v[i]) for k, v in out.items()})
        hashes = K.words(s.data, s.offsets, lower=False).hash
        plain = [x for t in texts[s.lo : s.hi] for x in WORD.findall(t or "")]
        assert len(hashes) == len(plain) and len(set(hashes.tolist())) == len(set(plain))
    assert len(got) == len(texts)
    for text, row in zip(texts, got):
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        repeated = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        assert row["n_words"] == len(words)
        assert row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == len(repeated)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    for s in K.text_slices(pa.array(texts, pa.string())):
        h, o = K.shingle_sets(K.words(s.data, s.offsets), s.hi - s.lo)
        sets = []
        for t in texts:
            w = WORD.findall((t or "").replace("Z", "z"))
            sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
        assert np.diff(o).tolist() == [len(x) for x in sets]
        for i in range(len(sets)):
            for j in range(i):
                assert len(np.intersect1d(h[o[i] : o[i + 1]], h[o[j] : o[j + 1]])) == len(sets[i] & sets[j])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.integers(1, 12))
def test_suffix_array(x, limit):
    sa = suffix_array(np.array(x, np.int64))
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    common = [0]
    for a, b in zip(sa, sa[1:]):
        k = 0
        while k < limit and max(a, b) + k < len(x) and x[a + k] == x[b + k]:
            k += 1
        common.append(k)
    assert common_prefixes(np.array(x, np.int64), sa, limit).tolist() == common


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=60), st.integers(1, 4))
def test_suffix_array_of_many_characters(x, times):
    x = x * times  # repeats need the names of names
    assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_array_recursion():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(900)]
    once = b" ".join(words[i] for i in rng.integers(0, 900, 3000))
    text = once + once[:9000] + b"ab" * 300 + b"z" * 200 + once[4000:]
    t = np.frombuffer(text, np.uint8).astype(np.int64)
    small = s_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    assert len({text[a:b] for a, b in zip(lms, lms[1:] + 1)}) > 512  # names of the first recursion
    assert suffix_array(t).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def edit_search(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=1, max_size=30), st.text("ab ", max_size=60))
def test_myers(pattern, text):
    assert D.myers(pattern, text)[0] == edit_search(pattern, text)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_pigeonhole_finds_every_item_within_budget(data):
    item = data.draw(st.text("abcdefgh ", min_size=30, max_size=60))
    item = D.normalise(item)
    if len(item) < D.SHORT_CHARS:
        return
    k = D.budget(len(item))
    copy = list(item)
    for _ in range(data.draw(st.integers(0, k))):
        at = data.draw(st.integers(0, max(len(copy) - 1, 0)))
        kind = data.draw(st.sampled_from("sdi"))
        if kind == "s" and copy:
            copy[at] = "x"
        elif kind == "d" and copy:
            del copy[at]
        else:
            copy.insert(at, "y")
    text = data.draw(st.text("abz ", max_size=40)) + "".join(copy) + data.draw(st.text("abz ", max_size=40))
    found = D.Matcher([(7, item)]).find(text)
    assert len(found) == 1 and found[0][1] == edit_search(item, text)


def test_kept_rows_come_in_small_batches():
    texts = [f"{i} " + "one two three four five " * 400 if i % 50 else None for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    model = Q.Model(np.zeros(1 << Q.BITS, np.int32), np.zeros((2, 1), np.float32), [-5.0, -5.0])
    got = list(Q.kept_rows([batch.slice(0, 0), batch], 1, model))
    assert [i for b in got for i in b.column(0).to_pylist()] == [i for i in range(400) if i % 50]
    assert batch.nbytes > 3_000_000 and max(sum(map(len, b.column(1).to_pylist())) for b in got) <= K.LEAN_BYTES


def test_tables_of_powers_follow_the_slices(monkeypatch):
    monkeypatch.setattr(K, "_powers", {})
    assert K.powers(1000, 3)[:4].tolist() == [1, 3, 9, 27]
    assert K.powers(5000, 3)[4999] == pow(3, 4999, 1 << 64) and len(K._powers[3]) <= 10_000

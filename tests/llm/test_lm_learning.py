"""What the language model learns: training texts alone, whatever else is scored and however the cluster is set."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from veldspan.llm import kernel, lm_scoring

DATA = "/root/testdata/sf0.001"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def scores(spark, rows):
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    return {r.doc_id: (r.base_score, r.score, r.bits_per_byte) for r in got}


def test_held_out_texts_change_nothing(spark, monkeypatch):
    """All held-out texts replaced (and much longer), or left out: every training document keeps its scores."""
    monkeypatch.setattr(lm_scoring, "TOKENS", 500)  # several chunks a bucket
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    first = scores(spark, rows)
    other = " ".join(f"{a}{b} the of and" for a in ("qu", "xo", "zy") for b in range(300))
    training = [i for i, _ in rows if not held_out(i)]
    assert 100 < len(training) < len(rows)
    for changed in ([(i, f"{other} {i}" * 20 if held_out(i) else t) for i, t in rows], [(i, t) for i, t in rows if not held_out(i)]):
        again = scores(spark, changed)
        for i in training:
            assert again[i] == pytest.approx(first[i], abs=1e-9)


def test_partitions_change_nothing(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    had, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(scores(spark, rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert all(got[0][i] == pytest.approx(got[1][i], abs=1e-9) for i, _ in rows)


def test_cuts_hold_whole_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    cuts = lm_scoring.whole_runs(keys, 30)
    assert cuts[0] == 0 and cuts[-1] == 500 and all(b - a >= 30 for a, b in zip(cuts, cuts[1:-1]))
    assert all(keys[c - 1] != keys[c] for c in cuts[1:-1])
    assert lm_scoring.whole_runs(keys[:0], 30) == [0]


def test_buckets_follow_the_corpus():
    mb = 1 << 20
    assert [lm_scoring.bucket_count(n) for n in (0, 100 * mb, 1000 * mb, 4096 * mb, 1 << 40)] == [8, 17, 167, 256, 1 << 15]


def test_powers_are_made_once_for_slices_of_like_length():
    """Slices beyond the kernel's own size differ a little in length; their powers were made anew for each longer one."""
    base = 0x1234567 | 1
    first = kernel.powers(3 << 20, base)
    assert np.shares_memory(kernel.powers((3 << 20) + 5000, base), first)
    assert kernel.powers(4, base).tolist() == [base**i % (1 << 64) for i in range(4)]


def test_head_words_are_found_as_by_binary_search():
    rng = np.random.default_rng(3)
    near = (np.uint64(5) << np.uint64(50)) + np.arange(20, dtype=np.uint64)  # many words share their first bits
    ends = np.array([0, (1 << 64) - 2], np.uint64)
    words = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), near, ends]))
    code = lm_scoring.Code(words, np.ones(len(words), np.int64), 1, 1)
    asked = np.concatenate([words, words + np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
    assert code.find(asked).tolist() == np.where(words[at] == asked, at + 2, lm_scoring.ESCAPE).tolist()
    assert lm_scoring.Code(words[:0], np.zeros(0, np.int64), 1, 1).find(asked).tolist() == [lm_scoring.ESCAPE] * len(asked)


@pytest.mark.parametrize("spread", [1 << 40, 1])
def test_distinct_keys_are_those_of_unique(spread):
    """Also where hashes differ in none of their first bits."""
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 300, 5000).astype(np.uint64) * np.uint64(spread << 16) | rng.integers(0, 9, 5000).astype(np.uint64)
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    at, mine = lm_scoring.distinct(keys)
    assert at.tolist() == first.tolist() and mine.tolist() == number.tolist()
    assert lm_scoring.order_of(keys).tolist() == np.argsort(keys, kind="stable").tolist()
    assert [x.tolist() for x in lm_scoring.distinct(keys[:0])] == [[], []]


def test_learning_equals_its_plain_form():
    """Bit by bit in Python: weights, biases and map of a few batches, some bits counted several times."""
    rng, n, many = np.random.default_rng(5), 700, 3
    inputs = [rng.integers(0, lm_scoring.CONFIDENCE * 256, n).astype(np.uint16) for _ in range(many)]
    gate, bit, times = rng.integers(0, lm_scoring.GATES, n), rng.integers(0, 2, n), rng.integers(1, 4, n).astype(float)
    mixer, plain = lm_scoring.Mixer(many), lm_scoring.Mixer(many)
    mixer.learn(inputs, gate, bit, times, batch=200)
    for lo in range(0, n, 200):
        part = range(lo, min(lo + 200, n))
        step, bias_step, total = np.zeros(plain.weights.shape), np.zeros(lm_scoring.GATES), times[lo : lo + 200].sum()
        ones, met = np.zeros(plain.map.shape), np.zeros(plain.map.shape)
        for i in part:
            at = [(k, gate[i], inputs[k][i] >> 8) for k in range(many)]
            x = [(int(inputs[k][i] & 255) - 128) / 14 for k in range(many)]
            z = np.float32(plain.bias[gate[i]])  # as wide as there, so that it falls into the same cell of the map
            for a, v in zip(at, x):
                z += np.float32(plain.weights[a]) * np.float32(v)
            z = np.clip(z, np.float32(-7.99), np.float32(7.99))
            error = (bit[i] - 1 / (1 + np.exp(-z))) * times[i]
            bias_step[gate[i]] += error / total
            for a, v in zip(at, x):
                step[a] += error * v / total
            cell = gate[i], int((z + np.float32(8)) * np.float32(lm_scoring.STEPS / 16) + np.float32(0.5))
            met[cell] += times[i]
            ones[cell] += times[i] * bit[i]
        plain.bias_power += bias_step**2
        plain.bias += 0.04 * bias_step / np.sqrt(plain.bias_power)
        plain.power += step**2
        plain.weights += 0.04 * step / np.sqrt(plain.power)
        p = 1 / (1 + np.exp(-plain.map))
        p += np.where(met > 0, met / (plain.seen + met + 64) * (ones / np.maximum(met, 1) - p), 0)
        plain.seen += met
        plain.map = np.log(p / (1 - p)).clip(-12, 12)
    for name in ("weights", "bias", "map", "seen"):
        assert getattr(mixer, name) == pytest.approx(getattr(plain, name), abs=1e-4)


def test_large_counts_keep_their_side():
    """Scaled to 255, not to 256 by a rounding: 269 zeros were read as a context never seen."""
    many = np.arange(256, 3000)
    none, few = np.zeros_like(many), np.ones_like(many)
    for one, state in ((none, 0), (few, 1)):
        assert set(lm_scoring.packed(many, one).tolist()) == {255 * 256 + state}
        assert set(lm_scoring.packed(one, many).tolist()) == {255 + 256 * state}

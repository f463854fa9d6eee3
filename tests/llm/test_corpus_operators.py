"""Corpus operators: edge rows, brute force on small tables, held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from math import log10

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldspan.llm import (
    components,
    decontamination,
    jaccard_join,
    language_id,
    licenses,
    lm_scoring,
    mixing,
    oracles,
    quality_classifier,
    quality_rules,
    queries,
    sharding,
    suffix_dedup,
)

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 3000
PASSAGE = " ".join(f"word{i} of{i % 7}" for i in range(60))

ROWS = [
    (1, PASSAGE, "en", "a", 1, "x", 1.0, "p"),
    (2, PASSAGE, "en", "a", 2, "x", 1.0, "p"),
    (2, PASSAGE, "en", "a", 2, "x", 1.0, "p"),
    (3, None, "en", "b", 3, None, None, None),
    (4, "", None, "b", 4, "x", 1.0, "p"),
    (5, " \n\t ", "fr", None, 5, "x", 1.0, "p"),
    (None, "no id but words enough to count as one short text", "fr", None, None, "x", 1.0, "p"),
    (None, None, None, None, None, None, None, None),
    (6, LONG, "de", "c", 6, "x", 1.0, "p"),
    (7, PASSAGE + " and a little more", "en", "c", 7, "x", 1.0, "p"),
    (8, "12345 67890 ###", "en", "c", 8, "x", 1.0, "p"),
    (9, "Licensed under the Apache License, Version 2.0.\n" + PASSAGE, "en", "c", 9, "x", 1.0, "p"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size double, path string"
BENCH = [(0, PASSAGE[:200]), (1, None), (2, ""), (3, PASSAGE[:200])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (8, None, 1), (99, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mix": lambda d, b, l: mixing.mix_plan(d),
    "curriculum": lambda d, b, l: mixing.curriculum(mixing.mix_plan(d)),
    "repeats": lambda d, b, l: suffix_dedup.remove_repeats(d),
    "classify": lambda d, b, l: quality_classifier.classify(d, l),
    "classify without labels": lambda d, b, l: quality_classifier.classify(d),
    "rules": lambda d, b, l: quality_rules.apply_rules(d),
    "licenses": lambda d, b, l: licenses.scan_licenses(d, path=licenses.document_path()),
    "language": lambda d, b, l: language_id.identify(d),
    "shards": lambda d, b, l: sharding.assign_shards(d),
    "links": lambda d, b, l: jaccard_join.link_components(d),
    "scores": lambda d, b, l: lm_scoring.score_texts(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_input_row(docs, benchmark, labels, name):
    rows = OPERATORS[name](docs, benchmark, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((r[0] is None, r[0]) for r in ROWS)
    assert OPERATORS[name](docs.limit(0), benchmark.limit(0), labels.limit(0)).collect() == []


def test_row_filters_keep_columns(docs, benchmark, labels):
    for stage in (
        lambda d: quality_classifier.keep_good(d, labels),
        lambda d: decontamination.drop_leaks(d, benchmark),
        lambda d: jaccard_join.keep_one_of_each(d),
        lambda d: mixing.mix_documents(d),
    ):
        out = stage(docs)
        assert out.columns == docs.columns and out.count() <= 3 * len(ROWS)
        assert stage(docs.limit(0)).count() == 0
    clean = {r.doc_id for r in decontamination.drop_leaks(docs, benchmark).collect()}
    assert not clean & {1, 2, 7, 9} and {3, 4, 5, 6, 8, None} <= clean
    kept = [r.doc_id for r in jaccard_join.keep_one_of_each(docs).collect() if r.doc_id in (1, 2, 7)]
    assert kept == [1]


def test_one_of_each_with_null_and_repeated_ids(spark):
    p, q, r = PASSAGE, " ".join(f"other{i}" for i in range(40)), " ".join(f"third{i}" for i in range(40))
    rows = [(1, p), (None, p), (None, p), (None, q), (None, q), (None, None), (5, ""), (5, ""), (3, r), (3, p), (4, r), (2, q + " tail")]
    kept = [tuple(x) for x in jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(kept, key=repr) == sorted([(1, p), (2, q + " tail"), (None, None), (5, ""), (5, ""), (3, r)], key=repr)
    nulls = [(None, q), (None, q), (None, q + " tail"), (9, r)]
    kept = [tuple(x) for x in jaccard_join.keep_one_of_each(spark.createDataFrame(nulls, "doc_id long, text string")).collect()]
    assert len(kept) == 2 and (9, r) in kept


def test_mix_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 9 + 1)), s) for i, s in enumerate("a" * 200 + "b" * 20 + "c" * 90)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = sum(i % 9 + 1 for i in range(len(rows)))
    assert sum(r.taken for r in plan) == pytest.approx(total, abs=3)
    for r in plan:
        assert 0 <= r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size + 1e-6 and (r.position is None or 0 <= r.position <= 1)
    by = {}
    for r in plan:
        by.setdefault(r.target, []).append(r.taken)
    assert all(sum(v) == pytest.approx(k, abs=1) for k, v in by.items())


def test_repeated_ids_do_not_pass_the_target(spark):
    """A third of the rows under one id, and rows alike in everything: each row has the copies of its own plan."""
    rows = [(7, "w w", "a", i) for i in range(40)] + [(i, "w w", "a", 0) for i in range(100, 160)] + [(7, "w w", "b", 0)] * 9 + [(None, "w w", "b", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(4)
    plan = mixing.mix_plan(docs).groupBy("target").agg(F.sum("copies").alias("n"), F.sum("taken").alias("taken")).collect()
    mixed = {r.source: r["count"] for r in mixing.mix_documents(docs).groupBy("source").count().collect()}
    assert sorted(mixed.values()) == sorted(r.n for r in plan)
    assert all(abs(2 * r.n - r.target) <= 2 and abs(r.taken - r.target) <= 1 for r in plan)


def test_training_time_inverts_the_integral(spark):
    for kind, knots in enumerate(mixing.SCHEDULES):
        rows = spark.range(101).select((F.col("id") / 100).alias("y")).withColumn("t", mixing.training_time(F.col("y"), F.lit(kind))).collect()
        for r in rows:
            done = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                t = min(max(r.t, t0), t1)
                done += (t - t0) * (w0 + w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / 2
            assert done / mixing.integral(knots) == pytest.approx(r.y, abs=1e-9)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql_twins(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS FROM '{SMALL}/{table}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else x
    twin = connection.sql(oracles.SQL[name])
    at = [twin.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in twin.fetchall()), key=repr)


def test_shards(spark):
    df = spark.read.parquet(f"{MORE}/documents.parquet")
    rows = sharding.assign_shards(df).join(df.select("doc_id", "source", "text"), "doc_id").collect()
    counts = {}
    for r in rows:
        raw = r.text.encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
        counts.setdefault(r.shard, []).append((r.slot, r.source))
    assert set(counts) == set(range(40)) and {len(v) for v in counts.values()} == {25}
    for v in counts.values():
        assert sorted(s for s, _ in v) == list(range(len(v)))
    share = sum(r.source == "src0" for r in rows) / 40
    assert all(abs(sum(s == "src0" for _, s in v) - share) <= 1.01 for v in counts.values())


def test_write_shards(spark, docs, tmp_path):
    """Every row once, with repeated and null ids, in the order of the plan."""
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3, files=2)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.groupBy("shard").count().count() == 3
    rows = [tuple(r) for r in out.select(*docs.columns).collect()]
    assert sorted(rows, key=repr) == sorted(ROWS, key=repr)
    plan = sorted((r.doc_id is None, r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(docs, 3).collect())
    assert plan == sorted((r.doc_id is None, r.doc_id, r.shard, r.slot) for r in out.collect())


def test_ranges_split_hot_ids_and_repeats(spark, monkeypatch):
    """A third of null ids and a third of rows alike: the largest range stays near the mean."""
    from veldspan.llm import shared

    made, write = [], shared.materialise
    monkeypatch.setattr(shared, "materialise", lambda df, name, path=None: made.append(write(df, name, path)) or made[-1])
    monkeypatch.setattr(shared, "RANGE_ROWS", 1000)
    n = 30_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("a").alias("g")
    )
    out = shared.running_before(rows, ["g"], ["doc_id"], F.lit(1), "before", n)
    assert sorted(r.before for r in out.collect()) == list(range(n))
    sizes = [r["count"] for r in made[0].groupBy("_range").count().collect()]
    assert max(sizes) < 3 * n / 30


def test_shards_keep_the_order_of_the_mix(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixed = mixing.mix_documents(docs, position_col="at")
    placed = sharding.assign_shards(mixed, 4, order_col="at", keep=("at",)).join(docs.select("doc_id", "source"), "doc_id").collect()
    for shard in range(4):
        for source in {r.source for r in placed}:
            mine = [r["at"] for r in sorted(placed, key=lambda r: r.slot) if r.shard == shard and r.source == source]
            assert mine == sorted(mine)


def test_operators_run_without_a_checkpoint_folder(spark, docs):
    from veldspan.sources import scratch

    class Session:  # a session whose spark.checkpoint.dir is unset
        sparkContext = spark.sparkContext
        _jsc = spark._jsc

        class conf:
            get = staticmethod(lambda key, default=None: default if key == "spark.checkpoint.dir" else spark.conf.get(key, default))

    assert scratch.shared_root(Session) == spark.conf.get("spark.sql.warehouse.dir")


def repeats_by_force(rows):
    first = {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        for j in range(len(raw) - 49):
            first.setdefault(raw[j : j + 50], i)
    out = {}
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - 49):
            if first[raw[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    pool = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5))]
        text = rng.choice(["", " ", "\n"]).join(parts)
        if parts and rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice("xyz") + text[at + rng.randint(0, 3) :]
        rows.append((i * 3, text))
    rows += [(1000, "a" * 500), (1001, "b" + "a" * 300), (1002, None), (1003, rows[5][1])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == repeats_by_force(rows)


def test_a_phrase_in_every_document(spark):
    """A hot anchor with other bytes around it: its windows spread over the buckets, and none is lost."""
    import random

    import numpy as np

    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    phrase, other = "this phrase stands in each of all texts", letters(30)
    rows = [(i, letters(40) + (other if i % 9 == 0 else letters(30)) + phrase + (other if i % 7 == 0 else letters(30)) + letters(20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(df)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == repeats_by_force(rows)
    # the phrase is hot, and as windows no fragment group of it is large
    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t) for _, t in rows)])
    row, first, last, h = suffix_dedup.fragments(raw, offsets)
    keys, n = np.unique(h.astype(np.uint32), return_counts=True)
    assert n.max() > 2000
    assert (last - first).max() > 0 and len(suffix_dedup.split_hot(raw, row, first, last, h, keys[n > 2000])[0]) > len(row)


def sent_fragments(deals, anchors, size, seed):
    """What match_fragments gets in one bucket: of each anchor, every deal has a fragment that differs from others in its ends."""
    import numpy as np

    rng = np.random.default_rng(seed)
    middle = rng.integers(97, 123, (anchors, size), np.uint8)
    rows, plain = [], []
    for d in range(deals):
        text = middle.copy()
        cut = rng.integers(0, 12, anchors)
        text[np.arange(anchors), cut] = rng.integers(97, 123, anchors)
        low = rng.integers(0, 1000, anchors)
        head = np.stack([np.arange(anchors) * 7919 + 1, low, low + rng.integers(0, 500, anchors), np.full(anchors, size)])
        rows.append((0, d, suffix_dedup.squeeze(head.astype(np.int64)), suffix_dedup.squeeze(text.reshape(-1)), None))
        plain += [(d, a, bytes(text[a]), int(head[1, a]), int(head[2, a])) for a in range(anchors)]
    return plain, [suffix_dedup._rows(rows)]


@pytest.mark.parametrize("turn, sort", [(1 << 30, 1 << 30), (3000, 400), (2000, 1)])
def test_fragments_match_in_turns(monkeypatch, turn, sort):
    """Turns and blocks hold whole anchors: each window gets its smallest id, whatever a task may hold."""
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "TURN_BYTES", turn)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort)
    plain, batches = sent_fragments(4, 40, 62, 1)
    least = {}
    for _, _, text, low, _ in plain:
        for j in range(len(text) - 49):
            least[text[j : j + 50]] = min(low, least.get(text[j : j + 50], low))
    number = {t: int(suffix_dedup.content_numbers(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for _, _, t, _, _ in plain}
    want = {(d, number[t], j, least[t[j : j + 50]]) for d, _, t, _, high in plain for j in range(len(t) - 49) if least[t[j : j + 50]] < high}
    got = set()
    for batch in suffix_dedup.match_fragments(batches):
        for d, _, a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
            content, span, low = suffix_dedup.expand(a, np.uint64), suffix_dedup.expand(b, np.uint8).reshape(-1, 3), suffix_dedup.expand(c, np.int64)
            got |= {(d, int(n), j, int(x)) for n, (u, v, _), x in zip(content, span, low) for j in range(int(u), int(v) + 1)}
    assert got == want


def test_matching_fragments_holds_little():
    """What sorting takes does not grow with the bucket: 10 MB of such fragments took 1,179 MB, now 105."""
    import tracemalloc

    _, batches = sent_fragments(4, 8_000, 62, 2)
    tracemalloc.start()
    try:
        for _ in suffix_dedup.match_fragments(batches):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6


def test_buckets_follow_the_bytes_of_text(spark, monkeypatch):
    """Few shuffle partitions do not make large buckets and deals."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1000, raising=False)
    rows = [(i, f"{i} " + PASSAGE[i : i + 200 + i] + f" end of {i}") for i in range(60)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.rdd.getNumPartitions() >= 2 * sum(len(t) for _, t in rows) // 1000
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == repeats_by_force(rows)


@pytest.mark.parametrize("ids", [(-(2**63), -5, 2**62 + 7, 2**63 - 1), (-5, 3, 2**62 + 7, 2**63 - 1), (-(2**63), -7, -6, 2**62 - 1)])
def test_repeats_of_any_id(spark, ids):
    text = [f"{i} {PASSAGE[: 100 + 20 * i]} end {i}" for i in range(4)]
    schema = "doc_id long, text string"
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(zip(ids, text)), schema)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == repeats_by_force(list(zip(ids, text)))
    with_null = suffix_dedup.remove_repeats(spark.createDataFrame([*zip(ids, text), (None, PASSAGE)], schema)).collect()
    assert {r.doc_id for r in with_null} == {*ids, None}
    assert [r.n_removed for r in with_null if r.doc_id is None][0] >= 160
    assert {r.doc_id: r.kept_sha256 for r in with_null if r.doc_id is not None} == {r.doc_id: r.kept_sha256 for r in got}


def test_large_clusters_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in range(i % 5):
            words[(i * 7 + j * 13) % 60] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"y{i}_{j}" for j in range(30))) for i in range(10)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == label


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_divide_skip_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.choice(1 << 40, 300, replace=False)
    sets = []
    for _ in range(40):
        keep = rng.random(300) < rng.choice([0.8, 0.9, 0.97])
        sets.append(np.unique(np.concatenate([base[keep], rng.choice(1 << 40, rng.integers(0, 40))])).astype(np.uint64))
    forest = components.Forest(40)
    for a in range(40):
        for b in range(a):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                forest.union(a, b)
    found = components.Forest(40)
    for a, b in jaccard_join.divide_skip(sets, range(40)):
        found.union(a, b)
    assert [forest.find(i) for i in range(40)] == [found.find(i) for i in range(40)]


def test_leaks(spark, docs, benchmark):
    got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.find_leaks(docs, benchmark).collect()}
    assert got == {(i, j, 0) for i in (1, 2, 7, 9) for j in (0, 3)}
    assert decontamination.find_leaks(docs, benchmark.limit(0)).count() == 0
    edited = spark.createDataFrame([(1, "before " + PASSAGE[:60] + "XY" + PASSAGE[63:200].upper() + " after")], "doc_id long, text string")
    assert {r.item_id for r in decontamination.find_leaks(edited, benchmark).collect()} == {0, 3}


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "What is two?"), (2, "four"), (3, " \t")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "so what  is two? indeed"), (2, "fourteen twenty-four"), (3, "fourteen"), (4, "what is twos?")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(texts, items).collect()} == {(1, 1), (2, 2)}
    assert {r.doc_id for r in decontamination.drop_leaks(texts, items).collect()} == {3, 4}


def test_license_inheritance(spark):
    mit, long = "Released under the MIT License.", " ".join(["plain"] * 200)
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c.txt", long), (3, "a/b/LICENSE.md", "Licensed under CC BY-NC 4.0."), (4, "a/x.txt", long),
        (5, "z/y.txt", long), (6, "z/h.txt", "Licensed under the Apache License, Version 2.0.\n" + long), (7, None, long), (8, "a/b/d/e.txt", None),
    ]
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "CC-BY-NC-4.0", "a/b"), 3: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 4: (None, "MIT", "a"),
        5: (None, None, None), 6: ("Apache-2.0", "Apache-2.0", None), 7: (None, None, None), 8: (None, "CC-BY-NC-4.0", "a/b"),
    }


def test_license_notices_in_running_text_and_full_texts(spark):
    prose = " ".join(f"plain{i % 50}" for i in range(100))
    gpl = "# This program is free software: you can redistribute\n# it and/or modify it under the terms\n# of the GNU General Public License\n"
    text = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")}
    rows = [
        (1, "a/x.txt", f"{prose} Released under the MIT License. {prose}"), (2, "b/x.txt", gpl + prose), (3, "c/x.txt", prose),
        (4, "d/x.txt", f"{prose} licensed\nunder the Apache\nLicense, Version\n2.0. {prose}"), (5, "e/y.txt", prose),
        (6, "e/notes.txt", text["LGPL-3.0"]), (7, "f/notes.txt", text["MPL-2.0"].replace("\n", " ")),
    ]
    got = {r.doc_id: (r.own_license, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "MIT"), 2: ("GPL", "GPL"), 3: (None, None), 4: ("Apache-2.0", "Apache-2.0"),
        5: (None, "LGPL-3.0"), 6: ("LGPL-3.0", "LGPL-3.0"), 7: ("MPL-2.0", "MPL-2.0"),
    }


def test_versions_of_licences_are_told_apart(spark):
    prose = " ".join(f"plain{i % 50}" for i in range(100))
    text = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")}
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version.\n"
    rows = [
        (1, gpl.format(2) + prose, "GPL-2.0"), (2, gpl.format(3) + prose, "GPL-3.0"), (3, "This work is licensed under the GNU General Public License, version 2. " + prose, "GPL-2.0"),
        (4, "Licensed under CC BY 3.0. " + prose, "CC-BY-3.0"), (5, "Licensed under the BSD 2-Clause License.\n" + prose, "BSD-2-Clause"),
        (6, text["ISC"], "ISC"), (7, text["BSD-2-Clause"], "BSD-2-Clause"), (8, text["BSD-3-Clause"], "BSD-3-Clause"),
        (9, text["GPL-3.0"], "GPL-3.0"), (10, text["GPL-3.0"].replace("Version 3", "Version 2").replace("version 3", "version 2"), "GPL-2.0"),
        (11, "Licensed under CC BY 2.5. " + prose, None), (12, "Copyright 2020. Released under the MIT License.", "MIT"),
    ]
    df = spark.createDataFrame([(i, f"d{i}/x.txt", t) for i, t, _ in rows], "doc_id long, path string, text string")
    assert {r.doc_id: r.own_license for r in licenses.scan_licenses(df).collect()} == {i: n for i, _, n in rows}


def test_licences_that_are_not_known_are_not_named(spark):
    """Headers of the wrong kind or version name no licence; tags and headings name theirs."""
    prose = " ".join(f"plain{i % 50}" for i in range(100))
    lesser = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {} General Public\nLicense as published by the Free Software Foundation; either\nversion {} of the License, or (at your option) any later version.\n"
    rows = [
        (lesser.format("Lesser", "2.1"), "LGPL-2.1"), (lesser.format("Lesser", "3"), "LGPL-3.0"), (lesser.format("Lesser", "2.0"), None), (lesser.format("Library", "2"), None),
        (lesser.replace("library", "program").format("Affero", "3"), "AGPL-3.0"), (lesser.replace("library", "program").format("Affero", "1"), None),
        ("Licensed under the Apache License, Version 1.1.\n", None), ("Licensed under the EUPL, Version 1.2 or later.\n", None), ("Licensed under the EUPL License.\n", None),
        ("// SPDX-License-Identifier: MIT\n", "MIT"), ("# SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"), ("/* SPDX-License-Identifier: LGPL-2.1-or-later */\n", "LGPL-2.1"),
        ("SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0"), ("SPDX-License-Identifier: EUPL-1.2\n", None), ("SPDX-License-Identifier: Zlib\n", None),
        ("MIT License\n\nCopyright (c) 2020 Someone\n", "MIT"), ("Mit Freunden\n", None), ("Licensed under CC BY-ND 4.0.\n", None), ("We spoke of the MIT License then.\n", None),
    ]
    df = spark.createDataFrame([(i, f"d{i}/x.txt", t + prose) for i, (t, _) in enumerate(rows)], "doc_id long, path string, text string")
    assert {r.doc_id: r.own_license for r in licenses.scan_licenses(df).collect()} == {i: n for i, (_, n) in enumerate(rows)}
    for name in ("GPL-2.0", "LGPL-2.1"):
        text = (licenses.TEXTS / f"{name}.txt").read_text()
        assert licenses.scan_licenses(spark.createDataFrame([(1, "a/b", text)], "doc_id long, path string, text string")).first().own_license == name


def test_cosines_by_force(spark):
    """The best cosine of a file, from word counts of every line and window."""
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 1500").limit(60)
    rows = docs.collect()
    token = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff-]+", "".join(c.lower() if c.isascii() else c for c in t))
    full = [f.read_text() for f in sorted(licenses.TEXTS.glob("*.txt"))]
    wanted = [token(t) for _, t in (*licenses.TEMPLATES, *licenses.LINES)] + [token(t) for t in full]
    vocabulary = {w for t in wanted for w in t}
    df = Counter(w for r in rows for w in set(token(r.text or "")) & vocabulary)
    idf = lambda w: math.log((1 + len(rows)) / (1 + df[w])) + 1 if w in vocabulary else math.log(1 + len(rows)) + 1

    def cosine(span, template):
        known, t = Counter(w for w in span if w in vocabulary), Counter(template)
        dot = sum(n * t[w] * idf(w) ** 2 for w, n in known.items())
        other = sum(w not in vocabulary for w in span)
        norm = math.sqrt(sum((n * idf(w)) ** 2 for w, n in known.items()) + other * (math.log(1 + len(rows)) + 1) ** 2)
        return dot / norm / math.sqrt(sum((n * idf(w)) ** 2 for w, n in t.items())) if span else 0.0

    marks = lambda span: sorted(w for w in span if re.search("[0-9]", w) or w in licenses.MARKS)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, path=licenses.document_path()).collect()}
    for r in rows:
        words = token(r.text or "")
        lines = [x for x in map(token, (r.text or "").split("\n")) if x]
        best = 0.0
        for i, t in enumerate(wanted[: len(licenses.TEMPLATES) + len(licenses.LINES)]):
            spans = lines
            if i < len(licenses.TEMPLATES):
                spans = [x for x in lines if len(x) >= licenses.MIN_LINE_WORDS] + [words[i : i + len(t)] for i in range(len(words) - len(t) + 1)]
            best = max([best, *(cosine(x, t) for x in spans if marks(x) == marks(t))])
        assert got[r.doc_id].cosine == pytest.approx(best if best >= licenses.MIN_COSINE else 0, abs=1e-5)


def test_expectation_maximisation_by_force():
    """The same estimates from single votes, one document at a time."""
    import numpy as np

    rng = np.random.default_rng(3)
    truth = rng.random(400) < 0.3
    votes = np.column_stack([np.where(rng.random(400) < 0.2, -1, np.where(rng.random(400) < a, truth, ~truth)) for a in (0.9, 0.8, 0.7)]).astype(np.int8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    got = quality_classifier.expectation_maximisation(patterns, counts.astype(float))
    p = [0.9 if (v == 1).any() else 0.02 for v in votes]
    for _ in range(60):
        prior = min(max((sum(p) + 1) / (len(p) + 4), 1e-4), 0.5)
        rates = {}
        for y in (0, 1):
            for j in range(3):
                n = [0.1 + sum(q if y else 1 - q for v, q in zip(votes, p) if v[j] == x) for x in (-1, 0, 1)]
                rates[y, j] = [x / sum(n) for x in n]
        p = []
        for v in votes:
            good, bad = 1 - prior, prior
            for j in range(3):
                good, bad = good * rates[0, j][v[j] + 1], bad * rates[1, j][v[j] + 1]
            p.append(bad / (good + bad))
    assert got["prior"] == pytest.approx(prior, abs=1e-6)
    assert all(got["rates"][y, j].tolist() == pytest.approx(rates[y, j], abs=1e-6) for y in (0, 1) for j in range(3))
    assert quality_classifier.posterior(votes, **got).tolist() == pytest.approx(p, abs=1e-6)
    assert abs(prior - truth.mean()) < 0.08 and np.mean((np.array(p) > 0.5) == truth) > 0.85


def test_junk_scorer_reads_words(spark):
    """Labels alone tell junk here: no ratio does, so the scorer must learn the words."""
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    spam = [f"s{i}" for i in range(12)]
    text = lambda bad: " ".join(rng.sample(plain, 60) + (rng.sample(spam, 6) if bad else []))
    rows = [(i, text(i % 4 == 0)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_classifier.classify(docs, labels).collect()}
    assert [i for i in range(600, 800) if got[i] != (i % 4 != 0)] == []


def test_classifier_agrees_with_labels(spark):
    docs, labels = spark.read.parquet(f"{MORE}/documents.parquet"), spark.read.parquet(f"{MORE}/labels.parquet")
    rows = quality_classifier.classify(docs, labels).join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0]
    toxic = [r.kept for r in rows if r.toxic == 1]
    assert sum(clean) >= 0.98 * len(clean) and sum(bad) <= 0.1 * len(bad) and sum(toxic) <= 0.25 * len(toxic)


def test_rules_keep_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{MORE}/documents.parquet"), spark.read.parquet(f"{MORE}/labels.parquet")
    rows = [r for r in quality_rules.apply_rules(docs).join(labels, "doc_id").collect() if not r.base_failed]
    clean = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(bad) <= 0.15 * len(bad)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) >= 0.94 * len(held)


def test_every_language_counts_whatever_the_block(spark, monkeypatch):
    """Rules and predictions are the same with one or three languages in a block."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    both = []
    for size in (1, 3, 256):
        monkeypatch.setattr(quality_rules, "LANG_BLOCK", size)
        monkeypatch.setattr(language_id, "LANG_BLOCK", size)
        both.append([sorted(map(tuple, f(docs).collect()), key=repr) for f in (quality_rules.apply_rules, language_id.identify)])
    assert both[0] == both[1] == both[2]


def test_nearest_centroid_by_force(spark):
    """Predictions equal a plain search of all centroids, with vectors made word by word."""
    import numpy as np

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    idf, models = language_id.fit(docs, "doc_id", "text", "lang")
    model = {k: v for m in models for k, v in m.items()}
    for r in language_id.identify(docs).join(docs, "doc_id").limit(40).collect():
        gap = r"[\x00-\x40\x5b-\x60\x7b-\x7f]"  # no n-gram crosses two gaps in a row
        text = b" \xff ".join(re.sub(gap, " ", x).lower().encode() for x in re.split(gap + "{2,}", r.text))
        counts = np.zeros(language_id.DIM)
        for n in language_id.NGRAMS:
            for i in range(len(text) - n + 1):
                gram = text[i : i + n]
                if gram == b" " or b"\xff" in gram:
                    continue
                h = n * 0x1B873593
                for j, b in enumerate(gram):
                    h = (h ^ b) * int(language_id._MULT[j]) & 0xFFFFFFFF
                counts[(h ^ h >> 15) % language_id.DIM] += 1
        v = np.log1p(counts) * idf
        best = {k: float((c @ v).max() / np.linalg.norm(v)) for k, (c, _) in model.items()}
        assert r.score == pytest.approx(max(best.values()), abs=1e-4) and best[r.lang_pred] >= max(best.values()) - 1e-4


def test_guard_of_common_words_changes_a_verdict(spark):
    """A language with few common words: a short text without any is no evidence, a long one is."""
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join("the" if rng.random() < 0.05 else word() for _ in range(400)), "xx") for i in range(30)]
    rows += [(100, " ".join(word() for _ in range(60)), None), (101, " ".join(word() for _ in range(400)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert got[100].kept and got[100].word_distance == 0
    assert not got[101].kept and got[101].word_distance > quality_rules.MAX_WORD_DISTANCE


def test_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}
    tokens = {r.doc_id: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(r.text or "")] + [None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts: dict = {}
    for i, t in tokens.items():
        if not held[i]:
            for w in t:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    better = []
    for i, t in tokens.items():
        r = got[i]
        base = sum(log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in t)
        assert r.held_out == held[i] and r.n_tokens == len(t) and r.n_known == sum(w in counts for w in t) and r.train_tokens == total
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
        if held[i]:
            better.append(r.score > base)
    assert sum(better) >= 0.9 * len(better)


def test_unknown_words_are_spelled(spark):
    """Unknown words are one event of the score, but telling them takes bits by their letters."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    ids = [i for i in range(10**6, 10**6 + 99) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    short, long = "zq", "zqxjkvbwqzxkjqvwzxqkjvbwzqxkjvqwzxkqjvbwzqx"
    got = {r.doc_id: r for r in lm_scoring.score_texts(docs.union(spark.createDataFrame(list(zip(ids, (short, long))), docs.schema))).collect()}
    one, two = (got[i] for i in ids)
    assert one.n_known == two.n_known == 1 and abs(one.score - two.score) < 1
    assert two.bits_per_byte * len(long) > one.bits_per_byte * len(short) + 2 * (len(long) - len(short))


def small_model(hot=(), pairs=()):
    import numpy as np

    counts = np.array([50, 30, 20, 9, 4, 3, 3])
    code = lm_scoring.Code(np.arange(10, 17, dtype=np.uint64), counts, 12, 40)
    model = lm_scoring.Shared(code, lm_scoring.Tree(np.ones(256, int)), np.array(hot, np.uint64), np.array(pairs, np.uint64), 4)
    _, node, bit, _ = code.expand(np.arange(9))
    zero = np.bincount(2 * node + bit, np.repeat([40, 12, *counts], code.size), minlength=2 * code.nodes)
    model.tables = [lm_scoring.pack(zero), np.zeros(1 << lm_scoring.HOT_BITS[0], np.uint16), np.zeros(1 << lm_scoring.HOT_BITS[1], np.uint16)]
    return model


def test_counts_by_runs_equal_counts_by_force():
    import numpy as np

    model, rng = small_model(), np.random.default_rng(2)
    one, sym = rng.integers(2, 6, 400).astype(np.uint64), rng.integers(0, 9, 400)
    key, times = np.unique((one << np.uint64(16)) | model.code.rank[sym], return_counts=True)
    context, symbols = key & ~np.uint64(0xFFFF), np.argsort(model.code.rank)[(key & np.uint64(0xFFFF)).astype(int)]
    got = lm_scoring.node_states(model.code, context, symbols, times)
    count = {}
    token, node, bit, _ = model.code.expand(symbols)
    for t, n, b in zip(token, node, bit):
        count[context[t], n, b] = count.get((context[t], n, b), 0) + times[t]
    assert got.tolist() == [count.get((context[t], n, 0), 0) * 256 + count.get((context[t], n, 1), 0) for t, n in zip(token, node)]


@pytest.mark.parametrize("hot", [(), (2, 3)])
def test_probabilities_of_a_context_add_up_to_one(hot):
    """Training tokens, and one token of every symbol under seen and unseen contexts, scored in one bucket."""
    import numpy as np

    rng = np.random.default_rng(1)
    model, n = small_model(hot), 3000
    one, two = rng.integers(2, 9, n), rng.integers(2, 5, n)
    sym = np.where(rng.random(n) < 0.7, one, rng.integers(0, 9, n))
    asked = [(a, b) for a, b in ((2, 2), (5, 3), (7, 88), (77, 2))]
    one = np.concatenate([one, *([a] * 9 for a, _ in asked)]).astype(np.uint64)
    two = np.concatenate([two, *([b] * 9 for _, b in asked)]).astype(np.uint64)
    sym, training = np.concatenate([sym, np.tile(np.arange(9), 4)]), np.arange(n + 36) < n
    log = lm_scoring.mix_tokens(model, lm_scoring.Mixer(3), one, two, sym, training.astype(np.uint8))
    assert (10 ** log[n:]).reshape(4, 9).sum(1) == pytest.approx(np.ones(4), abs=1e-4)
    flat = np.repeat(np.log10(np.bincount(sym[:n], minlength=9) / n)[sym[:n]].mean(), n)
    assert log[:n].mean() > flat.mean()  # the word before tells
    pair = lm_scoring.contexts(one[-9:], two[-9:])
    alone = lm_scoring.score_hot_pairs(model, *(lambda m: (m, m.luts(), m.costs()))(lm_scoring.Mixer(3)), *pair, np.arange(9))
    assert (10**alone).sum() == pytest.approx(1, abs=1e-4)


def test_scores_by_force(spark):
    """Ten texts in one bucket: the score is the sum of what each token costs by counts made word by word."""
    import numpy as np

    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(12)]
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1][:10]
    rows = [(i, " ".join(rng.choice(vocabulary, 40, p=np.arange(12, 0, -1) / 78).tolist())) for i in ids]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    # one model of all buckets is told by what it says: the same tokens, dealt and scored here without Spark
    from veldspan.llm import kernel

    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    w = kernel.words(data, np.cumsum([0, *(len(t) for _, t in rows)]))
    values, counts = np.unique(w.hash, return_counts=True)
    frequent = counts >= lm_scoring.MIN_HEAD_COUNT
    order = np.lexsort((values[frequent].view(np.int64), -counts[frequent]))
    code = lm_scoring.Code(values[frequent][order], counts[frequent][order], int(counts[~frequent].sum()), 10)
    sym, row, first = code.symbols(w, 10)
    one, two = lm_scoring.token_ids(w, sym, first)
    buckets = 2 * int(before)
    least = max(2, (len(w.hash) + 10) // (lm_scoring.HOT_SHARE * buckets))
    symbol_counts = np.bincount(sym, minlength=len(code.size))
    hot = np.concatenate([[0], np.flatnonzero(symbol_counts[2:] >= least) + 2]).astype(np.uint64)
    pair_count: dict = {}
    for a, b in zip(one.tolist(), two.tolist()):
        pair_count[a, b] = pair_count.get((a, b), 0) + 1
    many = np.array([k for k, n in pair_count.items() if n >= least], np.uint64).reshape(-1, 2)
    pairs = np.sort(lm_scoring.contexts(many[:, 0], many[:, 1])[1])
    model = lm_scoring.Shared(code, lm_scoring.Tree(np.ones(256, int)), hot, pairs, buckets)
    level = model.level(one, lm_scoring.contexts(one, two)[1])
    # counts of hot contexts, word by word
    count: dict = {}
    token, node, bit, depth = code.expand(sym)
    for t, n, b in zip(token.tolist(), node.tolist(), bit.tolist()):
        for context in ((), (one[t],), (one[t], two[t])):
            key = (*map(int, context), "node", n)
            count.setdefault(key, [0, 0])[b] += 1
    hot_bits = level[token] == 2
    assert (level == 2).any() and (level == 1).any() and (level == 0).any()
    states = [
        np.array([count[(*c(t), "node", n)][0] * 256 + count[(*c(t), "node", n)][1] for t, n in zip(token, node)], np.int64)
        for c in (lambda t: (), lambda t: (int(one[t]),), lambda t: (int(one[t]), int(two[t])))
    ]
    assert all((s >> 8 < 256).all() and (s & 255 < 256).all() for s in states)
    single, pair = lm_scoring.contexts(one, two)
    model.tables = [np.zeros(code.nodes, np.uint16), *(np.zeros(1 << b, np.uint16) for b in lm_scoring.HOT_BITS)]
    model.tables[0][node] = states[0]
    model.tables[1][lm_scoring.slots(single, token, node, lm_scoring.HOT_BITS[0])[level[token] >= 1]] = states[1][level[token] >= 1]
    model.tables[2][lm_scoring.slots(pair, token, node, lm_scoring.HOT_BITS[1])[hot_bits]] = states[2][hot_bits]
    log = np.zeros(len(sym))
    bucket = model.bucket_of(level, single, pair)
    for b in range(buckets):
        mine = bucket == b
        if mine.any():
            log[mine] = lm_scoring.mix_tokens(model, lm_scoring.Mixer(3), one[mine], two[mine], sym[mine], np.ones(mine.sum(), np.uint8))
    mixer = lm_scoring.Mixer(3)  # learns in the order of the text, before each piece is counted: nothing is counted yet
    some = np.flatnonzero(hot_bits)
    empty = [model.tables[0][node[some]], np.zeros(len(some), np.uint16), np.zeros(len(some), np.uint16)]
    mixer.learn(*lm_scoring.gated(empty, depth[some]), bit[some], np.ones(len(some)))
    fixed = lm_scoring.Mixer(3)
    fixed.settle(mixer.learned())
    use = level == 2
    log[use] = lm_scoring.score_hot_pairs(model, fixed, fixed.luts(), fixed.costs(), single[use], pair[use], sym[use])
    expected = np.bincount(row, log)
    assert not (sym == lm_scoring.ESCAPE).any()
    assert [got[i] for i in ids] == pytest.approx(expected.tolist(), abs=1e-3)


def test_share_of_new_words_is_exact():
    assert lm_scoring.new_share(1, 100_000) < 1e-4 and lm_scoring.new_share(0, 0) == 0.5 and 0 < lm_scoring.new_share(9, 9) < 1


def test_head_counts_all_training_documents(spark, monkeypatch):
    """A word of the last few of many documents is in the head if it is frequent in all."""
    seen = []
    monkeypatch.setattr(lm_scoring, "HEAD", 8)
    monkeypatch.setattr(lm_scoring, "huffman", lambda counts, make=lm_scoring.huffman: (len(counts) < 256 and seen.append(counts - 1)) or make(counts))
    train = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(i, "common words here") for i in train[:-1]] + [(train[-1], "burst " * 400)]
    lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    ends, escapes, *counts = seen[0].tolist()
    assert sorted(counts) == [400] + [len(train) - 1] * 3 and (escapes, ends) == (1, len(train))


def test_corpus_counts_pass_32_bits(spark):
    task = lm_scoring.Tables([4])
    task.counts[0][3] = 3_000_000_000
    ((block, raw),) = task.rows()
    parts = spark.createDataFrame([(block, bytearray(raw))] * 3, "block int, counts binary")
    assert lm_scoring.sum_tables(parts, [4])[0][0].tolist() == [0, 0, 0, 9_000_000_000, 0, 0, 0, 0]


def test_one_id_cannot_fill_a_sample(spark, monkeypatch):
    """An id of most rows teaches once; each of its rows is still judged."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    hot = docs.filter("n_chars < 1000").join(labels.select("doc_id"), "doc_id", "left_semi").orderBy("doc_id").limit(1)
    many = docs.unionByName(hot.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("i"))
    sizes, learn = [], quality_classifier.learn_lexicon
    monkeypatch.setattr(quality_classifier, "learn_lexicon", lambda t, toxic: sizes.append(len(toxic)) or learn(t, toxic))
    quality_classifier.classify(docs, labels)
    assert quality_classifier.classify(many, labels).count() == docs.count() + 300
    assert sizes[0] == sizes[1] > 0
    assert language_id.identify(many).count() == docs.count() + 300


def test_a_hot_id_does_not_thin_out_its_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANG", 20)
    rows = [(i, f"some words of text {i} {i % 7}", "xx") for i in range(60)] + [(1, "the same again", "xx")] * 20_000
    rows += [(100 + i, f"andere woorden hier {i}", "yy") for i in range(60)]
    _, models = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    (model,) = models
    assert set(model) == {"xx", "yy"} and len(model["xx"][0]) == language_id.CLUSTERS


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, now, SMALL)
        assert out.columns == docs.columns
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        assert ids == sorted(set(ids)) and set(ids) <= {r.doc_id for r in now.select("doc_id").collect()}
        kept.append(set(ids))
        now = spark.createDataFrame(out.collect(), docs.schema)
    good = {r.doc_id for r in quality_classifier.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).filter("kept").collect()}
    assert kept[0] == good
    leaked = {r.doc_id for r in decontamination.find_leaks(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert not kept[2] & leaked and kept[1] - leaked == kept[2]
    mixed = corpus_pipeline.STAGES[3][1](spark, now, SMALL)
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(now).collect() if r.copies}
    assert copies == plan and mixed.columns == docs.columns
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, n in copies.items() for _ in range(n))


def test_pipeline_on_null_repeated_and_empty_rows(spark, tmp_path):
    for name, rows in (("edge", ROWS), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"node": "_mix_key", "size": "_row"}).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(BENCH if rows else [], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        spark.createDataFrame([(1, 1, 0), (8, None, 1), (None, 1, 1)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and len({(r.shard, r.slot) for r in got}) == len(got)

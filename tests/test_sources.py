"""Round trips of readers and writers."""

from __future__ import annotations

import json

from veldspan.sources import readers, writers


def test_delimited_round_trip(spark, tmp_path):
    rows = [("007", 'say "hi"\tthere'), ("8", "plain, text"), ("9", "üñï")]
    writers.write_delimited(spark.createDataFrame(rows, readers.CAPTIONS), str(tmp_path / "t"))
    assert sorted(map(tuple, readers.read_delimited(spark, str(tmp_path / "t"), readers.CAPTIONS).collect())) == sorted(rows)


def test_manifest_levels(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tcaption\n01\tx\n")
    (tmp_path / "b.tsv").write_text("id\tcaption\tq_level\n01\tx\t3\n02\ty\t\n")
    assert [tuple(r) for r in readers.read_manifest(spark, str(tmp_path / "a.tsv")).collect()] == [("01", "x", 9)]
    assert sorted(tuple(r) for r in readers.read_manifest(spark, str(tmp_path / "b.tsv")).collect()) == [("01", "x", 3), ("02", "y", 9)]
    assert readers.read_manifest(spark, str(tmp_path / "b.tsv"), readers.NULL_LEVEL).first().q_level == 10


def test_tolerant_reader_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("id\tname\tstart_sample\tend_sample\na\tn\t0\t10\nb\tn\tzero\t10\n")
    good, bad = readers.read_tolerant(spark, str(tmp_path / "c.tsv"), readers.CLIPS)
    assert [r.id for r in good.collect()] == ["a"] and [r.line for r in bad.collect()] == ["b\tn\tzero\t10"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id": "a", "clap_sim": 0.1}\n\n{"id": "a", "clap_sim": 0.3}\n{"id": "b", "clap_sim": 0.2}\n')
    assert {r.id: r.clap_sim for r in readers.read_similarity(spark, str(tmp_path / "s.jsonl")).collect()} == {"a": 0.3, "b": 0.2}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "one.json").write_text('{"audio_prompt": "rain",\n "x": 1}')
    assert tuple(readers.read_entities(spark, str(tmp_path / "e")).first()) == ("one", "rain")
    (tmp_path / "m.json").write_text('[{"path": "00/1.mp3"}, {"path": "00/2.mp3"}]')
    assert readers.read_documents(spark, str(tmp_path / "m.json")).count() == 2


def test_lines_listing_and_logs(spark, tmp_path):
    (tmp_path / "order.txt").write_text("b.npz\n\n  a.npz \n")
    assert [tuple(r) for r in readers.read_lines(spark, str(tmp_path / "order.txt")).orderBy("pos").collect()] == [(0, "b.npz"), (1, "a.npz")]
    assert [tuple(r) for r in readers.sequence_names(spark, 2).collect()] == [(0, "0.npz"), (1, "1.npz")]
    (tmp_path / "x.wav").write_bytes(b"12")
    assert [r.stem for r in readers.list_files(spark, str(tmp_path)).collect()] == ["x"]
    (tmp_path / "run.log").write_text("it 1 loss:0.5\nclap_score: 0.25\n")
    assert [r.line for r in readers.newest_log(spark, str(tmp_path), 1).collect()] == ["clap_score: 0.25"]
    assert [tuple(r) for r in readers.read_metrics(spark, str(tmp_path / "run.log")).collect()] == [("clap_score", 0.25)]


def test_lines_follow_file_names(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a0\na1\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(5000)))
    (tmp_path / "c.txt").write_text("c0\n")
    got = [r.line for r in readers.read_lines(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == ["a0", "a1", *(f"b{i}" for i in range(5000)), "c0"]


def test_arrays_and_rotation(spark, tmp_path):
    import numpy as np

    (tmp_path / "n").mkdir()
    np.savez(tmp_path / "n" / "1.npz", mean=np.ones((2, 2)), std=np.zeros(3))
    np.savez(tmp_path / "n" / "2.npz", mean=np.arange(2.0))
    got = {r.id: (r["mean"], r["std"]) for r in readers.read_arrays(spark, str(tmp_path / "n"), ("mean", "std")).collect()}
    assert got == {"1": ([1.0] * 4, [0.0] * 3), "2": ([0.0, 1.0], None)}
    rows = spark.range(3)
    assert [writers.rotate(rows, str(tmp_path / "r")) for _ in range(4)] == [0, 1, 2, 3]
    assert sorted(p.name for p in (tmp_path / "r").glob("version=*")) == ["version=2", "version=3"]


def test_writers(spark, tmp_path):
    metrics = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "key string, value double")
    writers.write_metrics(metrics, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"a": 1.0, "b": 2.0}
    for i in range(2):
        writers.append_series(metrics, str(tmp_path / "s"))
        writers.write_version(metrics.limit(i + 1), str(tmp_path / "v"), i)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    assert readers and writers.read_latest(spark, str(tmp_path / "v")).count() == 2
    assert writers.fingerprint(metrics) == writers.fingerprint(metrics.orderBy("key")) != writers.fingerprint(metrics.limit(1))
    assert not writers.already_done(spark, str(tmp_path / "mark"), n=1)
    writers.mark_done(spark, str(tmp_path / "mark"), n=1)
    assert writers.already_done(spark, str(tmp_path / "mark"), n=1) and not writers.already_done(spark, str(tmp_path / "mark"), n=2)
    writers.write_features(spark.createDataFrame([(1, [1.0]), (0, [2.0])], "idx long, mean array<float>"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2


def test_shards_against_a_manifest(spark, tmp_path):
    """Every kind of bad shard is named, from footers; only those are counted from the data."""
    from pyspark.sql import functions as F

    from veldspan.sources import shards

    rows = spark.range(80).select(F.col("id"), (F.col("id") % 8).alias("shard"))
    manifest = shards.manifest_of(rows, "shard", "id")
    kept = rows.filter("shard NOT IN (1, 2) AND id <> 40").unionByName(spark.createDataFrame([(19, 3), (900, 11)], "id long, shard long"))
    kept = kept.withColumn("id", F.when(F.col("id") == 4, 1004).otherwise(F.col("id"))).unionByName(rows.filter("shard = 5").withColumn("shard", F.lit(2).cast("long")))
    shards.write_sharded(kept, str(tmp_path / "s"), "shard", "id")
    got = {r.shard: (r.status, r.rows, r.expected, r.distinct_keys) for r in shards.verify_shards(spark, str(tmp_path / "s"), manifest, "shard", "id").collect()}
    assert got == {
        0: ("short", 9, 10, 9), 1: ("missing", None, 10, None), 2: ("repeated", 10, 10, 10), 3: ("long", 11, 10, 10), 4: ("bounds", 10, 10, 10),
        5: ("ok", 10, 10, None), 6: ("ok", 10, 10, None), 7: ("ok", 10, 10, None), 11: ("unexpected", 1, None, 1),
    }


def test_sketches_of_parts_are_those_of_the_whole(spark):
    from pyspark.sql import functions as F

    from veldspan.functions import sketches

    rows = spark.range(20_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 4000).alias("user"), F.sqrt("id").alias("x"))
    parts = sketches.summarised(rows, ["day"], {"users": F.col("user")}, {"x": F.col("x")})
    whole = sketches.merged(parts, [], ["users"], ["x"]).select("rows", sketches.distinct_estimate("users").alias("n"), sketches.quantile_estimate("x", 0.25).alias("q"), sketches.rank_estimate("x", 100.0).alias("r")).first()
    assert whole.rows == 20_000 and abs(whole.n - 4000) < 200 and abs(whole.q**2 / 20_000 - 0.25) < 0.02 and abs(whole.r - 0.5) < 0.02


def test_partials_keep_the_order_of_files_and_rows(spark, tmp_path):
    for rank in (1, 0):
        for part in (0, 1):
            rows = [(10 * rank + 5 * part + i,) for i in (3, 1, 2)]
            spark.createDataFrame(rows, "v long").coalesce(1).write.parquet(str(tmp_path / "w"))
            (tmp_path / "p" / f"rank={rank}").mkdir(parents=True, exist_ok=True)
            next((tmp_path / "w").glob("part*")).rename(tmp_path / "p" / f"rank={rank}" / f"f{part}.parquet")
            (tmp_path / "w").rename(tmp_path / f"gone-{rank}-{part}")
    got = [r.v for r in readers.combined(readers.read_partials(spark, str(tmp_path / "p"))).orderBy("pos").collect()]
    assert got == [3, 1, 2, 8, 6, 7, 13, 11, 12, 18, 16, 17]


def test_packed_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [3.0], [4.0])], "k long, a array<double>, b array<double>")
    writers.write_arrays(rows, str(tmp_path / "a"), "k", {"mean": "a", "std": "b"})
    got = {r.id: (r["mean"], r["std"]) for r in readers.read_packed_arrays(spark, str(tmp_path / "a"), ("mean", "std")).collect()}
    assert got == {"1": ([1.0, 2.0], None), "2": ([3.0], [4.0])}


def test_a_local_warehouse_is_no_shared_folder(spark):
    import types

    import pytest

    from veldspan.sources import scratch

    conf = types.SimpleNamespace(get=lambda key, default=None: {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}.get(key, default))
    cluster = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_root(cluster)
    cluster.sparkContext.master = "local[4]"
    assert scratch.shared_root(cluster) == "file:/tmp/warehouse"


def test_packed_entities(spark, tmp_path):
    rows = [(f"a/{i}=x", f'say "{i}"\n', i) for i in range(200)] + [(None, "rain", 1), ("none", None, 2)]
    path = tmp_path / "packed"
    writers.write_entities(spark.createDataFrame(rows, "id string, audio_prompt string, x long").coalesce(2), str(path))
    assert len(list(path.rglob("*.parquet"))) == 2
    assert json.loads(spark.read.parquet(str(path)).filter("id = 'a/7=x'").first().content) == {"audio_prompt": 'say "7"\n', "x": 7}
    assert {tuple(r) for r in readers.read_packed_entities(spark, str(path)).collect()} == {r[:2] for r in rows}
    assert {r[0] for r in readers.read_packed_entities(spark, str(path), "other").select("other").collect()} == {None}


def test_entity_files_of_suppliers_without_a_key(spark, tmp_path):
    from veldspan.plans import registry

    spark.createDataFrame([(1, "one"), (None, "nobody"), (3, None)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {tuple(r) for r in registry.queries()["entity_files"](spark, str(tmp_path)).collect()}
    assert got == {("entity1", "one"), (None, "nobody"), ("entity3", None)}

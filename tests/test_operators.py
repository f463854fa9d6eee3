"""Edge rows of the operators, as small literal tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from veldspan.functions import text as T
from veldspan.functions import vectors as V
from veldspan.functions.ordering import with_position
from veldspan.operators import candidates, lookup, metrics, sampling, segment, series, validate
from veldspan.streaming import progress
from veldspan.streaming.progress import drain, publish, run_lengths


@pytest.mark.parametrize(
    ("total", "spans"),
    [(4, []), (5, [(0, 10)]), (10, [(0, 10)]), (19, [(0, 10)]), (20, [(0, 10), (10, 20)]), (35, [(0, 10), (12, 22), (24, 34)]), (100, [(i * 22, i * 22 + 10) for i in range(5)])],
)
def test_segments(spark, total, spans):
    rows = segment.clip_segments(spark.createDataFrame([("a", total)], "id string, n long"), "id", "n", 10).orderBy("start_sample").collect()
    assert [(r.start_sample, r.end_sample) for r in rows] == spans
    assert [r.clip_id for r in rows] == [f"a_{i}" for i in range(len(spans))]


def test_caption_policies(spark):
    clips = spark.createDataFrame([("a",), ("b",)], "name string")
    captions = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "id string, pos int, caption string")
    last = lookup.attach_captions(clips, captions, "name", "id", "pos", "caption").collect()
    every = lookup.attach_captions(clips, captions, "name", "id", "pos", "caption", "all").collect()
    assert [r.caption for r in last] == ["y"] and sorted(r.caption for r in every) == ["x", "y"]
    assert [r.name for r in lookup.without_match(clips, captions, "name", "id").collect()] == ["b"]
    assert lookup.caption_list(captions, "id", "pos", "caption").first().captions == ["x", "y"]


def test_locate(spark):
    sources = spark.createDataFrame([("a", 0, 3), ("b", 1, 2)], "source string, ordinal int, size long")
    probes = spark.createDataFrame([(i,) for i in (0, 2, 3, -1, -6, 5)], "idx long")
    got = {r.idx: (r.source, r.local_index) for r in lookup.locate(probes, sources, "idx").collect()}
    assert got == {0: ("a", 0), 2: ("a", 2), 3: ("b", 0), -1: ("b", 1)}


def test_slice_or_pad(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert df.select(V.slice_or_pad(F.col("x"), 1, 5)).first()[0] == [1, 2, 3, 0, 0]
    assert df.select(V.slice_or_pad(F.col("x"), 1, 3)).first()[0] == [2, 3]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        V.cosine(a, b).alias("c"), V.normalised(a).alias("n"), V.close(a, a).alias("same"), V.close(a, b).alias("other"), V.finite(a).alias("f"),
        V.average_pool(a, 2).alias("p"), V.transposed(F.array(a, b)).alias("t"), V.mean_of(F.array(a, b)).alias("m"), V.linspace(0, 1, 2).alias("l"),
        V.peak_normalised(F.array(F.lit(0.0))).alias("silent"), V.guided(a, b, F.lit(0.5)).alias("g"), V.mono(a, b).alias("mono"),
        V.reparameterised(a, b, F.array(F.lit(1.0), F.lit(0.0))).alias("r"),
    ).first()
    assert row.c == pytest.approx(0.96) and row.n == pytest.approx([0.6, 0.8]) and row.same and not row.other and row.f
    assert row.p == [3.5] and row.t == [[3, 4], [4, 3]] and row.m == [3.5, 3.5] and row.l == [0, 0.5, 1]
    assert row.silent is None and row.g == [3, 4] and row.mono == [3.5, 3.5] and row.r == [7, 4]
    empty = spark.createDataFrame([([0.0],)], "a array<double>").select(V.normalised(F.col("a")).alias("n")).first()
    assert empty.n == [None]


def test_binned_mean(spark):
    points = spark.createDataFrame([(0.0, 1.0), (0.039, 3.0), (0.04, 5.0), (1.0, 9.0), (None, 1.0)], "t double, v double")
    got = {r.bin: (r.n, r["mean"]) for r in metrics.binned_mean(points, F.col("t"), "v").collect()}
    assert got[0] == (2, 2.0) and got[1] == (1, 5.0) and got[24][0] == 0 and math.isnan(got[24][1]) and len(got) == 25


def test_two_level_mean(spark):
    points = spark.createDataFrame([("k", 0, 1.0)] * 3 + [("k", 1, 4.0)], "k string, r int, v double")
    row = metrics.mean_of_rank_means(points, "k", F.col("r"), "v").first()
    assert (row.mean_of_means, row.plain_mean) == (2.5, 1.75)


def test_running_average(spark):
    points = spark.createDataFrame([("a", i, v) for i, v in enumerate((10.0, 2.0, 4.0))] + [("b", 0, 1.0)], "k string, i int, v double")
    got = {r.k: r.average for r in series.running_average(points, "k", ["i"], "v").collect()}
    assert got == {"a": 2.6, "b": None}


def test_running_average_of_a_key_in_many_ranges(spark):
    rows = [("hot", i, (i * 37 % 101) / 7) for i in range(3000)] + [("hot", 5, 5 * 37 / 7)] * 3
    rows += [(None, i, float(i)) for i in range(4)] + [("gap", i, None if i == 1 else 1.0) for i in range(9)]
    rows += [("late gap", i, None if i == 8 else 1.0) for i in range(9)] + [("first", i, None if i == 0 else 2.0) for i in range(3)]
    points = spark.createDataFrame(rows, "k string, i int, v double").withColumnsRenamed({"v": "_value"})

    def folded(key):
        v = [x[2] for x in sorted((r for r in rows if r[0] == key), key=lambda r: r[1])]
        out = v[1]
        for x in v[2:]:
            out = None if out is None or x is None else 0.7 * out + 0.3 * x
        return len(v), out

    got = {r.k: (r.points, r.average) for r in series.running_average(points, "k", ["i"], "_value").collect()}
    assert set(got) == {r[0] for r in rows}
    for key, (n, average) in got.items():
        assert (n, average) == (folded(key)[0], pytest.approx(folded(key)[1], abs=1e-6) if folded(key)[1] is not None else None)
    assert series.running_average(points.limit(0), "k", ["i"], "_value").count() == 0


@pytest.mark.parametrize(("flags", "alerts"), [([1] * 9 + [0], 0), ([1] * 10, 1), ([1] * 11, 1), ([1] * 10 + [0] + [1] * 10, 2)])
def test_bad_runs_batch_and_stream(spark, tmp_path, flags, alerts):
    rows = spark.createDataFrame([("t", i, bool(f)) for i, f in enumerate(flags)], "k string, i int, bad boolean")
    assert series.bad_runs(rows, "k", ["i"], F.col("bad")).first().alerts == alerts
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drain(spark, run_lengths(stream, "k", "bad", 10), "append").collect()
    assert any(r.alert for r in got) == bool(alerts)


def test_publish_writes_a_batch_once(spark, tmp_path):
    """The second run adds its own batch; a batch that runs again after its write changes nothing."""
    paths = [str(tmp_path / x) for x in ("board", "history", "check")]
    for i in range(2):
        spark.range(5 * i, 5 * i + 5).write.mode("append").parquet(str(tmp_path / "in"))
        stream = progress.stream_table(spark, str(tmp_path / "in")).groupBy().count()
        publish(stream, *paths).awaitTermination()
        assert progress.latest(spark, paths[0]).first()[0] == 5 * i + 5
        assert spark.read.parquet(paths[1]).count() == i + 1
    write = progress.once(str(tmp_path / "once"))
    for rows in (spark.range(3), spark.range(8)):
        write(rows, 0)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 3


def test_a_partitioned_table_is_streamed_whole(spark, tmp_path):
    rows = spark.range(1000).withColumn("part", F.col("id") % 2)
    rows.write.partitionBy("part").parquet(str(tmp_path / "events.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "plain.parquet"))
    one = next((tmp_path / "plain.parquet").glob("part*"))
    for path in (tmp_path / "events.parquet", tmp_path / "plain.parquet", one):
        assert drain(spark, progress.stream_table(spark, str(path)), "append").count() == 1000


def test_run_alerts_wait_for_late_points(spark, tmp_path):
    """Points that arrive out of order within the watermark give the alerts of their order in time; silence ends a run."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    at = lambda minute: start + dt.timedelta(minutes=minute)
    batches = [
        [("a", at(2), 2, True), ("a", at(0), 0, True), ("b", at(1), 10, True), ("b", at(2), 11, None)],
        [("a", at(1), 1, True), ("a", at(3), 3, True), ("b", at(3), 12, True), ("b", at(4), 13, True), (None, at(3), 30, True)],
        [("a", at(300), 4, False), ("b", at(200), 14, True), ("b", None, 15, True)],
        [("a", at(600), 5, True), ("b", at(601), 16, True)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "k string, ts timestamp, n long, bad boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for idle, want in ((None, [("a", 2), ("b", 14)]), ("1 hour", [("a", 2)])):
        stream = progress.stream_table(spark, str(tmp_path / "in"), 1)
        got = drain(spark, progress.run_alerts(stream, "k", "ts", "n", "bad", 3, "10 minutes", idle), "append", progress.ROCKS).collect()
        assert sorted((r.key, r.n) for r in got) == want


def test_trailing_flags(spark):
    rows = spark.createDataFrame([("a", i, f) for i, f in enumerate((1, 0, 1))] + [("b", i, f) for i, f in enumerate((1, 0, 0, 1))], "k string, i int, f int")
    got = {(r.k, r.i) for r in series.trailing_flags(rows, "k", ["i"], F.col("f") == 1).filter("alert").collect()}
    assert got == {("a", 2)}


def test_frame_hold(spark):
    frames = spark.createDataFrame([("s", t) for t in (0.0, 0.6, 1.1)], "s string, at double")
    got = [(r.tick, r["at"]) for r in series.frame_hold(frames, "s", "at", 2).orderBy("tick").collect()]
    assert got == [(0, 0.0), (1, 0.6), (2, 1.1)]


@pytest.mark.parametrize(("value", "shown"), [(0.125, "0.12"), (2.675, "2.67"), (1234.565, "1234.57")])
def test_prompts(spark, value, shown):
    row = spark.createDataFrame([(value, "c")], "x double, c string").select(T.alignment_prompt("x", F.col("c")).alias("a"), T.consistency_prompt("x", F.col("c")).alias("b")).first()
    assert row.a == f"Text alignment is {shown}. c" and row.b == f"[consistency={shown}] c"


def test_text_functions(spark):
    row = spark.range(1).select(
        T.safe_name(F.lit("A dog. is/barking")).alias("n"), T.stem(F.lit("x/y/00/a.b.mp3")).alias("s"), T.flat_id(F.lit("00/7.mp3")).alias("f"),
        T.duration(F.lit(90061)).alias("d"), T.duration(F.lit(3660)).alias("h"), T.metric_line(F.lit("clap_score: 0.25"), "clap_score").alias("m"),
        T.metric_line(F.lit("other"), "clap_score").alias("x"), T.crashed(F.lit("it 3 loss:nan")).alias("c"),
    ).first()
    assert tuple(row) == ("A_dog_is_barking", "a.b", "00_7.wav", "1d 1h", "1h 1m", 0.25, None, True)


def test_manifest(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "idx long, name string")
    a = rows((0, "x"), (1, "y"))
    assert validate.manifest_verdict(a, None, "idx", ["name"]) == "write"
    assert validate.manifest_verdict(a, rows((0, "x")), "idx", ["name"]) == "length"
    assert validate.manifest_verdict(a, rows((0, "y"), (1, "x")), "idx", ["name"]) == "mismatch"
    assert validate.manifest_verdict(a, a, "idx", ["name"]) == "ok"
    assert validate.manifest_mismatches(a, rows((1, None), (2, None)), "idx", ["name"]).count() == 3


def test_positions_and_levels(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 5) for i in range(103)], "id long, x long")
    got = [r.id for r in with_position(rows, "x", "id").orderBy("pos").collect()]
    assert got == sorted(range(103), key=lambda i: ((i * 7) % 5, i))
    sizes = [r["count"] for r in sampling.levels(rows, "x", "id").groupBy("q_level").count().orderBy("q_level").collect()]
    assert sizes == [11, 11, 11] + [10] * 7
    empty = with_position(rows.limit(0), "x", "id")
    assert empty.count() == 0 and "pos" in empty.columns


def test_sampling_is_repeatable_and_exact(spark):
    rows = spark.range(200).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in sampling.sample_exactly(rows, 50, "s", "k").collect()) for _ in range(2))
    other = sorted(r.k for r in sampling.sample_exactly(rows, 50, "t", "k").collect())
    assert a == b != other and len(a) == 50
    shards = sampling.shuffled_shards(rows, 1, 3, "k").groupBy("shard").count().collect()
    assert sorted(r["count"] for r in shards) == [66, 67, 67]


def test_consensus_needs_no_pairs(spark):
    rows = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [0.0, 2.0]), ("g", 3, [1.0, 1.0]), ("h", 4, [1.0, 0.0])], "g string, id int, v array<double>")
    got = {r.id: r.consensus for r in candidates.consensus(rows, "g", "v").collect()}
    assert got[3] == pytest.approx(0.707107, abs=1e-6) and got[1] == pytest.approx(0.353553, abs=1e-6) and got[4] is None
    assert candidates.pick_one(candidates.consensus(rows, "g", "v").filter("g = 'g'"), "g", F.col("consensus"), "id").first().id == 3


def test_gather_wants_one_record_a_key(spark):
    import pytest

    from veldspan.operators import validate

    wanted = spark.createDataFrame([(1,), (2,)], "k long")
    once = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    assert sorted(map(tuple, validate.gathered(wanted, once, "k").collect())) == [(1, "a"), (2, "b")]
    for bad in (once.union(once), once.filter("k > 1")):
        with pytest.raises(Exception, match="not one record for"):
            validate.gathered(wanted, bad, "k").collect()


def test_full_frechet_distance(spark):
    import numpy as np

    from veldspan.operators import metrics

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(300, 4)), rng.normal(size=(200, 4)) @ np.diag([1, 2, 0.5, 1]) + 0.3
    frame = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "e array<double>")
    got = metrics.frechet_full(frame(a), frame(b), "e").first()
    ca, cb = np.cov(a.T), np.cov(b.T)
    cross = np.sqrt(np.maximum(np.linalg.eigvals(ca @ cb).real, 0)).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * cross
    assert got.dims == 4 and abs(got.frechet - want) < 1e-5
    same = metrics.frechet_full(frame(a), frame(a), "e").first()
    assert abs(same.frechet) < 1e-5


def test_nearest_items_in_many_parts(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (180, 4)).astype(float)  # many equal scores, some zero vectors
    rows = [(i, int(i % 3), v.tolist()) for i, v in enumerate(x)] + [(900, 0, None), (901, 1, [float("nan")] * 4)]
    items = spark.createDataFrame(rows, "id long, label int, v array<float>").repartition(3)
    queries = items.filter("id % 4 = 0")
    good = [i for i in range(180) if x[i].any()]
    unit = {i: x[i] / np.linalg.norm(x[i]) for i in good}
    want = {(q, i) for q in good if q % 4 == 0 for _, i in sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in good if i != q)[:5]}
    for sizes in ({}, {"query_rows": 10, "item_rows": 16}):
        near = metrics.nearest_items(queries, items, "id", "label", "v", 5, **sizes)
        got = [(r.q, r.i) for r in near.collect()]
        assert len(got) == len(want) and set(got) == want
    same = np.mean([any(i % 3 == q % 3 for a, i in want if a == q) for q in {q for q, _ in want}])
    row = metrics.recall_at_k(queries, items, "id", "label", "v", 5, query_rows=10, item_rows=16).first()
    assert row.queries == len({q for q, _ in want}) and row.recall == pytest.approx(same, abs=1e-6)
    assert metrics.recall_at_k(queries.limit(0), items, "id", "label", "v", 5).first().queries == 0


def test_batches_are_read_by_all_tasks(spark, tmp_path):
    from veldspan.plans.streams import in_batches

    rows = spark.range(0, 400, 1, 4).withColumn("task", F.spark_partition_id())
    in_batches(rows, str(tmp_path / "in"), F.col("id") % 2, 2)
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 2
    got = spark.read.parquet(str(tmp_path / "in"))
    assert got.count() == 400 and got.select("task").distinct().count() == 4

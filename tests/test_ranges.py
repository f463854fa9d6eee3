"""Scans over ranges: a hot key in many ranges, ties, nulls, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veldspan.functions import ordering, ranges
from veldspan.operators import intervals, lookup, series


@pytest.fixture(scope="module")
def points():
    random.seed(5)
    rows = [("hot", random.randint(0, 400), i, random.choice([None, 1, 2, 3])) for i in range(900)]
    rows += [("hot", 200, 1000 + i, 7) for i in range(400)]  # a third alike in the order
    rows += [(k, i, 2000 + 50 * n + i, i % 3) for n, k in enumerate(("a", "b", None)) for i in range(40)]
    rows += [("z", None, 3000, 1), ("z", 1, 3001, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, n long, v long").repartition(6)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def order():
    return [F.col("t"), F.col("n")]


@pytest.mark.parametrize("cut", [1, 23])
def test_scans(spark, points, cut):
    rows = frame(spark, points)
    got = {
        "sum": ranges.with_running_sum(rows, ["k"], order(), F.col("v"), "x", cut),
        "previous": ranges.with_previous(rows, ["k"], order(), "v", "x", cut),
        "last": ranges.with_nearest_set(rows, ["k"], order(), "v", "x", ranges=cut),
        "next": ranges.with_nearest_set(rows, ["k"], order(), "v", "x", True, cut),
        "recent": ranges.with_recent(rows, ["k"], order(), "v", "x", 7, cut),
        "one": ranges.with_recent(rows, ["k"], order(), "v", "x", 1, cut),
    }
    got = {name: {r.n: r.x for r in df.collect()} for name, df in got.items()}
    for rows_of in by_key(points).values():
        values = [r[3] for r in rows_of]
        for i, r in enumerate(rows_of):
            assert got["sum"][r[2]] == sum(v or 0 for v in values[:i])
            assert got["previous"][r[2]] == (values[i - 1] if i else None)
            assert got["last"][r[2]] == next((v for v in reversed(values[: i + 1]) if v is not None), None)
            assert got["next"][r[2]] == next((v for v in values[i:] if v is not None), None)
            assert got["recent"][r[2]] == values[max(0, i - 6) : i + 1]
            assert got["one"][r[2]] == [r[3]]
    assert ranges.with_recent(rows.limit(0), ["k"], order(), "v", "x", 7, cut).count() == 0


def test_positions_by_key_with_ties_and_nulls(spark, points):
    got = {r.n: (r.pos, r.total) for r in ordering.with_position(frame(spark, points), "t", "n", keys=("k",), total="total").collect()}
    for rows_of in by_key(points).values():
        last = sorted(rows_of, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in last] == [(i, len(last)) for i in range(len(last))]
    names = spark.createDataFrame([("b",), (None,), ("a",), ("a",)], "s string")
    assert [r.s for r in ordering.with_position(names, "s").orderBy("pos").collect()] == ["a", "a", "b", None]


def test_runs_and_flags_over_ranges(spark):
    random.seed(9)
    flags = {"hot": [random.random() < 0.9 for _ in range(1500)], "all": [True] * 300, "none": [False] * 30, None: [True, False, True, True]}
    rows = spark.createDataFrame([(k, i, f) for k, v in flags.items() for i, f in enumerate(v)], "k string, i long, bad boolean").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many small ranges
    try:
        got = {r.k: (r.runs, r.longest, r.alerts) for r in series.bad_runs(rows, "k", ["i"], F.col("bad"), 10).collect()}
        alerts = {(r.k, r.i): r.alert for r in series.trailing_flags(rows, "k", ["i"], F.col("bad"), 5, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, v in flags.items():
        lengths = [len(x) for x in "".join("x" if f else " " for f in v).split()]
        assert got.get(k) == ((len(lengths), max(lengths), sum(n >= 10 for n in lengths)) if lengths else None)
        assert all(alerts[k, i] == (sum(v[max(0, i - 4) : i + 1]) >= 5) for i in range(len(v)))


@pytest.mark.parametrize(("forward", "strict"), [(False, False), (True, False), (False, True), (True, True)])
def test_asof_join(spark, forward, strict):
    random.seed(3)
    key = lambda: random.choice(["hot", "hot", "hot", "a", None])
    left = [(i, key(), random.choice([None, *range(60)])) for i in range(300)]
    right = [(i, key(), random.choice([None, *range(0, 60, 3)])) for i in range(80)]
    got = intervals.asof_join(
        spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "mark long, k string, u long"), ["k"], "t", "u", ["mark", "u"], "mark", forward, strict, 13
    ).collect()
    assert len(got) == len(left)
    for r in got:
        fits = [(u, m) for m, k, u in right if k == r.k and u is not None and r.t is not None and ((u > r.t or u == r.t and not strict) if forward else (u < r.t or u == r.t and not strict))]
        assert (r.u, r.mark) == ((min(fits) if forward else max(fits)) if fits else (None, None))


def test_asof_join_of_one_key_with_a_million_points(spark):
    left = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("t"))
    right = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") * 3000).alias("u"))
    joined = intervals.asof_join(left, right, ["k"], "t", "u", ["u"], ranges=40)
    assert joined.filter("u <> t - t % 3000").count() == 0 and joined.count() == 1_000_000


def test_interval_join(spark):
    random.seed(4)
    spans = [(i, s, s + random.choice([0, 1, 2, 5, 64, 65, 1000, 40_000])) for i, s in enumerate(random.choices(range(-30_000, 30_000), k=200))] + [(900, None, 3), (901, 5, 2)]
    at = [(i, random.choice([None, *range(-40_000, 80_000, 17)])) for i in range(400)]
    joined = intervals.interval_join(spark.createDataFrame(at, "p long, at long"), spark.createDataFrame(spans, "s long, low long, high long"), "at", "low", "high")
    want = {(p, s) for p, a in at for s, low, high in spans if None not in (a, low) and low <= a < high}
    rows = [(r.p, r.s) for r in joined.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_interval_join_compares_places_not_points(spark):
    points = spark.range(40_000).select(F.col("id").alias("p"), F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") < 30_000, F.lit(7)).otherwise(F.col("id") % 50).alias("at"))
    spans = spark.createDataFrame([(i, i % 40, i % 40 + 9) for i in range(80)], "s long, low long, high long")
    placed = intervals.places(points, "at").select(F.size("_points").alias("n")).collect()
    assert sum(r.n for r in placed) == 36_000 and 26 < len(placed) < 90 and max(r.n for r in placed) < 2 * intervals.PLACE_ROWS
    joined = intervals.interval_join(points, spans, "at", "low", "high")
    got = {(r.at, r.low): (r.n, r.p) for r in joined.groupBy("at", "low").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("p")).collect()}
    here = {r.at: r.n for r in points.filter("at is not null").groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(a, low): (2 * n, n) for a, n in here.items() for low in range(40) if low <= a < low + 9}


def test_locate_among_a_million_sources(spark):
    sources = spark.range(1_000_000).select(F.col("id").alias("source"), F.col("id").alias("ordinal"), (F.col("id") % 5).alias("size"))
    probes = spark.createDataFrame([(0,), (1_999_999,), (-1,), (-2_000_000,), (2_000_000,), (-2_000_001,), (10,)], "idx long")
    got = {r.idx: (r.source, r.local_index) for r in lookup.locate(probes, sources, "idx").collect()}
    assert got == {0: (1, 0), 1_999_999: (999_999, 3), -1: (999_999, 3), -2_000_000: (1, 0), 10: (6, 0)}

"""Ordered series: running averages, durations, runs of bad values and trailing flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import with_position
from ..functions.ranges import KEY, RANGE, Scan, with_previous, with_recent


def running_average(points: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.7) -> DataFrame:
    """(key, points, average): the first value is dropped, the second is the start, then alpha old + (1 - alpha) new.

    A key with one point has no average, nor has one with a null value after its first point.
    Points alike in ``order`` come by value; a null key is a key.  So that a key of very many points is not one task,
    points are cut into ranges of keys and order.  A value weighs alpha to the number of points after it: ranges add up their
    weighted values, and a table of one row for each key and range brings them together.
    """
    by = [f"_o{i}" for i in range(len(order))] + ["_value"]
    rows = points.select(F.col(key).alias("_key"), *[F.col(c).alias(b) for c, b in zip(order, by)], F.col(value).cast("double").alias("_value"))
    ranged = rows.repartitionByRange("_key", *by).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_key", "_range")
    placed = ranged.withColumn("_i", F.row_number().over(inside.orderBy(*by))).withColumn("_n", F.count(F.lit(1)).over(inside))
    late = F.col("_i") > 2  # the first two of a range may be the first two of the key
    ranges = placed.groupBy("_key", "_range").agg(
        F.max("_n").alias("_n"),
        F.coalesce(F.sum(F.when(late, F.pow(F.lit(alpha), F.col("_n") - F.col("_i")) * F.col("_value"))), F.lit(0.0)).alias("_late"),
        F.max(F.when(F.col("_i") == 1, F.col("_value"))).alias("_one"),
        F.max(F.when(F.col("_i") == 2, F.col("_value"))).alias("_two"),
        F.max(late & F.col("_value").isNull()).alias("_gap"),
    )
    others = lambda o: F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy(o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", others(F.asc("_range"))).withColumn("_after", others(F.desc("_range")))
    fading = lambda after: F.pow(F.lit(alpha), F.col("_after") + after)
    start = F.col("_before") == 0
    one = F.when(start, F.lit(0.0)).otherwise(F.when(F.col("_before") == 1, F.lit(1.0)).otherwise(1 - alpha) * fading(F.col("_n") - 1) * F.col("_one"))
    two = F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(F.when(start, F.lit(1.0)).otherwise(1 - alpha) * fading(F.col("_n") - 2) * F.col("_two"))
    part = F.when(~F.col("_gap"), (1 - alpha) * fading(F.lit(0)) * F.col("_late") + one + two)
    series = ranges.groupBy("_key").agg(F.sum("_n").cast("int").alias("points"), F.sum(part).alias("_sum"), F.max(part.isNull()).alias("_lost"))
    return series.select(F.col("_key").alias(key), "points", F.when((F.col("points") > 1) & ~F.col("_lost"), F.round("_sum", 6)).alias("average"))


def remaining_seconds(points: DataFrame, key: str, order: list[str], value: str, steps: int, every: int = 1, alpha: float = 0.7) -> DataFrame:
    """Adds to the running averages the time left: remaining steps times the average of ``every`` steps; 0 without an average."""
    left = F.greatest(F.lit(steps) - F.col("points") * every, F.lit(0)) * F.col("average") / every
    return running_average(points, key, order, value, alpha).withColumn("seconds_left", F.round(F.coalesce(left, F.lit(0.0)), 6))


def step_durations(points: DataFrame, key: str, order: list[str], ts: str) -> DataFrame:
    """Adds the seconds since the key's previous point; null at its first."""
    timed = points.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    before = with_previous(timed, [key], [F.col(c) for c in order], "_us", "_before")
    return before.withColumn("seconds", F.round(F.col("_us") / 1e6 - F.col("_before") / 1e6, 3)).drop("_us", "_before")


def bad_runs(points: DataFrame, key: str, order: list[str], bad: Column, alert_at: int = 10) -> DataFrame:
    """(key, runs, longest, alerts): runs of consecutive bad points; a run alerts once, when it reaches ``alert_at``.

    A null flag is not bad.  Runs are counted in ranges of the key's points; a run that touches the start of its range
    goes on from one that touches the end of the range before.
    """
    scan = Scan(points.withColumn("_bad", F.coalesce(bad.cast("int"), F.lit(0))), [key], [F.col(c) for c in order])
    marked = scan.rows.withColumn("_island", F.sum(1 - F.col("_bad")).over(scan.inside)).withColumn("_i", F.row_number().over(scan.inside))
    sizes = scan.summaries(_n=F.count(F.lit(1))).withColumn("_earlier", F.lag(RANGE).over(scan.across))
    runs = marked.filter("_bad = 1").groupBy(KEY, RANGE, "_island").agg(F.min("_i").alias("_from"), F.max("_i").alias("_to")).join(sizes, [KEY, RANGE])
    # of a range, at most the first and the last run are at its borders
    border = runs.filter((F.col("_from") == 1) | (F.col("_to") == F.col("_n")))
    over = Window.partitionBy(KEY).orderBy(RANGE, "_from")
    goes_on = (F.col("_from") == 1) & (F.lag(RANGE).over(over) == F.col("_earlier")) & (F.lag(F.col("_to") == F.col("_n")).over(over))
    chained = border.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(over))
    length = F.col("_to") - F.col("_from") + 1
    whole = chained.groupBy(KEY, "_run").agg(F.sum(length).alias("_length")).select(KEY, "_length")
    whole = whole.unionByName(runs.filter((F.col("_from") > 1) & (F.col("_to") < F.col("_n"))).select(KEY, length.alias("_length")))
    counted = whole.groupBy(KEY).agg(F.count(F.lit(1)).alias("runs"), F.max("_length").cast("long").alias("longest"), F.count_if(F.col("_length") >= alert_at).alias("alerts"))
    return counted.select(F.col(KEY)[key].alias(key), "runs", "longest", "alerts")


def trailing_flags(points: DataFrame, key: str, order: list[str], flag: Column, window: int = 3, least: int = 2) -> DataFrame:
    """Adds ``alert``: at least ``least`` of the last ``window`` rows of the key are flagged; null where none of them says."""
    flagged = with_recent(points.withColumn("_flag", flag.cast("int")), [key], [F.col(c) for c in order], "_flag", "_recent", window)
    known = F.filter("_recent", lambda x: x.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0), lambda s, x: s + x))
    return flagged.withColumn("alert", total >= least).drop("_flag", "_recent")


def frame_hold(frames: DataFrame, stream: str, at: str, rate: int) -> DataFrame:
    """(stream, tick, at): each tick of ``rate`` a second, up to the last frame, shows the first frame at or after it.

    A frame is shown at the ticks after the frame before it: intervals, not a join.
    """
    rows = with_previous(frames, [stream], [F.col(at)], at, "_previous")
    first = F.coalesce(F.floor(F.col("_previous") * rate) + 1, F.lit(0))
    spans = rows.withColumn("_from", first).withColumn("_to", F.floor(F.col(at) * rate)).filter("_from <= _to")
    return spans.select(stream, F.explode(F.sequence("_from", "_to")).alias("tick"), F.col(at).alias("at"))


def interval_rates(points: DataFrame, key: str, order: list[str], ts: str, every: int) -> DataFrame:
    """(key, interval, seconds_per_step): seconds from the first to the last of ``every`` points in a row, by their number."""
    placed = with_position(points.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))), order[0], *order[1:], name="_pos", keys=(key,))
    seconds = (F.max("_us") - F.min("_us")) / F.lit(1e6) / F.count(F.lit(1))
    return placed.groupBy(key, F.expr(f"_pos div {every}").alias("interval")).agg(F.round(seconds, 2).alias("seconds_per_step"))

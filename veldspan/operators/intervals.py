"""As-of joins and joins of points with intervals, without a nested loop and without a task for a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import with_nearest_set

PLACE_ROWS = 1024  # points of one place that are held as one row


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_at: str,
    right_at: str,
    columns: list[str],
    tie: str | None = None,
    forward: bool = False,
    strict: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the key's last ``right`` row at or before it (``forward``: first at or after it).

    ``strict`` leaves out rows of ``right`` at the same time.  Among those alike in time the one with the
    largest ``tie`` is taken (``forward``: the smallest; without ``tie`` any of them, the same for the
    same input).  A row without a partner, or with a null time, gets nulls; null keys match null keys.  Both sides are sorted
    together in ranges of key and time; a range hands on the last right row of each of its keys.
    """
    side_first = 1 if forward else 0  # at one time, right rows come first backward and last forward, and the other way round if strict
    right_side, left_side = (side_first, 1 - side_first) if not strict else (1 - side_first, side_first)
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    extra = F.col(tie).alias("_tie") if tie else F.lit(0).alias("_tie")
    no_tie = F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie")
    row_type, got_type = left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType, right.select(F.struct(*columns).alias("s")).schema["s"].dataType
    points = left.select(*key, F.col(left_at).alias("_at"), F.lit(left_side).alias("_side"), no_tie, F.struct(*left.columns).alias("_row"), F.lit(None).cast(got_type).alias("_got"))
    marks = right.filter(F.col(right_at).isNotNull()).select(
        *key, F.col(right_at).alias("_at"), F.lit(right_side).alias("_side"), extra, F.lit(None).cast(row_type).alias("_row"), F.struct(*columns).alias("_got")
    )
    both = points.unionByName(marks)
    order = [F.col(c) for c in ("_at", "_side", "_tie")]
    met = with_nearest_set(both, [f"_k{i}" for i in range(len(keys))], order, "_got", "_near", forward, ranges).filter("_row IS NOT NULL")
    got = F.when(F.col("_at").isNotNull(), F.col("_near"))
    return met.select("_row.*", got.alias("_near")).select(*left.columns, *[F.col("_near")[c].alias(c) for c in columns])


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and an interval with start <= at < end; all columns of both, whole numbers.

    An interval lies in at most two bins of the least power of two that is not shorter than it; a point
    looks into its bin of each such size that occurs (64 at most, read first).  So bins are met by equality, whatever the
    lengths and overlaps, and an interval is never cut into many.  Points at one place look as one row, in groups of about
    ``PLACE_ROWS``, and part only when their intervals are found.  Empty intervals and nulls meet nothing.
    """
    length = F.col(end) - F.col(start)
    sized = intervals.filter(length > 0).withColumn("_level", F.when(length == 1, F.lit(0)).otherwise(F.length(F.bin(length - 1))).cast("int"))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())
    bins = F.array_distinct(F.array(F.expr(f"shiftright(`{start}`, _level)"), F.expr(f"shiftright(`{end}` - 1, _level)")))
    dealt = sized.withColumn("_bin", F.explode(bins))
    looked = places(points, at).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", F.expr("shiftright(_place, _level)"))
    met = looked.join(dealt, ["_level", "_bin"]).filter((F.col("_place") >= F.col(start)) & (F.col("_place") < F.col(end)))
    # a place's points part last: what is compared grows with places, not with points
    return met.select(F.explode("_points").alias("_point"), *intervals.columns).select("_point.*", *intervals.columns)


def places(points: DataFrame, at: str) -> DataFrame:
    """(_place, _points): the points of each place that is not null; a place of over ``PLACE_ROWS`` is dealt over several rows."""
    placed = points.filter(F.col(at).isNotNull()).select(F.col(at).alias("_place"), F.struct(*points.columns).alias("_point"))
    full = placed.groupBy("_place").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PLACE_ROWS)
    parts = full.select("_place", F.ceil(F.col("_n") / PLACE_ROWS).alias("_parts"))
    dealt = placed.join(parts, "_place", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")), F.lit(0)))
    return dealt.groupBy("_place", "_part").agg(F.collect_list("_point").alias("_points")).select("_place", "_points")

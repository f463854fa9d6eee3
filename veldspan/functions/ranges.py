"""Ordered work on keys of any size: segmented scans over ranges.

A window over a key sends all its rows to one task.  Here rows are range-sorted by key, order and
a number of their own, so neither a hot key nor rows alike in all of the order fill a range.  Each range
gives one summary row for each of its keys; what comes before a range is folded over these rows, and
handed back to the range's rows, which are finished in windows of one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored

KEY, RANGE, TWIN = "_key", "_range", "_twin"


class Scan:
    """Rows of ``keys`` cut into ranges of ``order`` (ascending, nulls first; ties by where rows stand in the input).

    ``keys`` may be empty (all rows are one key) and hold nulls, which are keys like others.  ``rows``
    is the cut table: it is written once, as two readers must see the same ranges.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[Column], ranges: int | None = None):
        by = {f"_o{i}": c for i, c in enumerate(order)}
        key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
        numbered = rows.withColumns({KEY: key, **by, TWIN: F.monotonically_increasing_id()})
        sort = [KEY, *by, TWIN]
        cut = numbered.repartitionByRange(ranges, *sort) if ranges else numbered.repartitionByRange(*sort)
        self.columns = rows.columns
        self.rows = stored(cut.withColumn(RANGE, F.spark_partition_id()), "ranges")
        self.place = F.struct(*by, TWIN)  # tells a row's place among all
        self.inside: WindowSpec = Window.partitionBy(KEY, RANGE).orderBy(*by, TWIN)
        self.across: WindowSpec = Window.partitionBy(KEY).orderBy(RANGE)

    def before(self) -> WindowSpec:
        """The summaries of the key's earlier ranges."""
        return self.across.rowsBetween(Window.unboundedPreceding, -1)

    def after(self) -> WindowSpec:
        """The summaries of the key's later ranges."""
        return self.across.rowsBetween(1, Window.unboundedFollowing)

    def summaries(self, **own: Column) -> DataFrame:
        """One row a key and range with the aggregates ``own``."""
        return self.rows.groupBy(KEY, RANGE).agg(*[c.alias(name) for name, c in own.items()])

    def carrying(self, own: dict[str, Column], handed: dict[str, Column]) -> DataFrame:
        """The rows, each with ``handed``: windows over the key's summaries ``own``."""
        table = self.summaries(**own).select(KEY, RANGE, *[c.alias(name) for name, c in handed.items()])
        return self.rows.join(table, [KEY, RANGE])

    def first_in_range(self) -> Column:
        return F.row_number().over(self.inside) == 1

    def finished(self, rows: DataFrame, *added: str) -> DataFrame:
        return rows.select(*self.columns, *added)


def with_running_sum(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the key's rows before this one; null values count as 0."""
    value = F.coalesce(value, F.lit(0))
    scan = Scan(rows.withColumn("_value", value), keys, order, ranges)
    carried = scan.carrying({"_sum": F.sum("_value")}, {"_carried": F.coalesce(F.sum("_sum").over(scan.before()), F.lit(0))})
    inside = F.coalesce(F.sum("_value").over(scan.inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return scan.finished(carried.withColumn(name, F.col("_carried") + inside), name).drop("_value")


def with_previous(rows: DataFrame, keys: list[str], order: list[Column], column: str, name: str, ranges: int | None = None) -> DataFrame:
    """Adds the value of ``column`` in the key's row before this one; null at its first."""
    scan = Scan(rows, keys, order, ranges)
    last = {"_last": F.max_by(F.struct(F.col(column).alias("v")), scan.place)}
    carried = scan.carrying(last, {"_carried": F.lag("_last").over(scan.across)})
    value = F.when(scan.first_in_range(), F.col("_carried.v")).otherwise(F.lag(column).over(scan.inside))
    return scan.finished(carried.withColumn(name, value), name)


def with_nearest_set(rows: DataFrame, keys: list[str], order: list[Column], column: str, name: str, forward: bool = False, ranges: int | None = None) -> DataFrame:
    """Adds the last value of ``column`` that is not null, up to this row of the key; with ``forward`` the next one from it on."""
    scan = Scan(rows, keys, order, ranges)
    seen = F.when(F.col(column).isNotNull(), scan.place)
    if forward:
        carried = scan.carrying({"_v": F.min_by(column, seen)}, {"_carried": F.first("_v", ignorenulls=True).over(scan.after())})
        inside = F.first(column, ignorenulls=True).over(scan.inside.rowsBetween(0, Window.unboundedFollowing))
    else:
        carried = scan.carrying({"_v": F.max_by(column, seen)}, {"_carried": F.last("_v", ignorenulls=True).over(scan.before())})
        inside = F.last(column, ignorenulls=True).over(scan.inside.rowsBetween(Window.unboundedPreceding, 0))
    return scan.finished(carried.withColumn(name, F.coalesce(inside, "_carried")), name)


def with_recent(rows: DataFrame, keys: list[str], order: list[Column], column: str, name: str, count: int, ranges: int | None = None) -> DataFrame:
    """Adds an array of the values of ``column`` in the key's last ``count`` rows, this one included (fewer at its start)."""
    scan = Scan(rows.withColumn("_value", F.struct(F.col(column).alias("v"))), keys, order, ranges)
    own = F.collect_list("_value").over(scan.inside.rowsBetween(1 - count, 0))
    if count == 1:
        return scan.finished(scan.rows.withColumn(name, F.transform(own, lambda x: x["v"])), name).drop("_value")
    from_end = [F.desc(c) for c in scan.rows.columns if c.startswith("_o") or c == TWIN]
    late = scan.rows.withColumn("_late", F.row_number().over(Window.partitionBy(KEY, RANGE).orderBy(*from_end))).filter(F.col("_late") < count)
    tails = late.groupBy(KEY, RANGE).agg(F.transform(F.sort_array(F.collect_list(F.struct(scan.place.alias("p"), "_value"))), lambda x: x["_value"]).alias("_tail"))
    # every range of a key has at least one row: the last count - 1 rows are in its last count - 1 ranges
    carried = tails.select(KEY, RANGE, F.flatten(F.collect_list("_tail").over(scan.across.rowsBetween(1 - count, -1))).alias("_carried"))
    both = scan.rows.join(carried, [KEY, RANGE]).withColumn("_both", F.concat("_carried", own))
    recent = F.slice("_both", F.greatest(F.size("_both") - count + 1, F.lit(1)), F.lit(count))
    return scan.finished(both.withColumn(name, F.transform(recent, lambda x: x["v"])), name).drop("_value")

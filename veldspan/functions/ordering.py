"""Dense positions and seeded order without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import Scan


def seeded_unit(seed: str, key: Column) -> Column:
    """A repeatable number in [0, 1) from the md5 of ``seed:key``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_position(df: DataFrame, order: str, *ties: str, name: str = "pos", keys: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """Adds the dense position (from 0) of each row of its key in the order of a column (of any type), then ``ties``; nulls last.

    Rows alike in all of these come as they stand in the input.  ``total`` names a column for the rows
    of the key.  Rows are counted by range; only the rows of one range meet in a window.
    """
    scan = Scan(df, list(keys), [F.col(order).isNull(), *[F.col(c) for c in (order, *ties)]])
    handed = {"_before": F.coalesce(F.sum("_n").over(scan.before()), F.lit(0))}
    if total:
        handed[total] = F.sum("_n").over(Window.partitionBy("_key"))
    placed = scan.carrying({"_n": F.count(F.lit(1))}, handed)
    placed = placed.withColumn(name, (F.col("_before") + F.row_number().over(scan.inside) - 1).cast("long"))
    return scan.finished(placed, name, *([total] if total else []))


def equal_frequency(position: Column, rows: Column, levels: int) -> Column:
    """The level (from 0) of a dense position when ``rows`` rows are dealt to equal levels, larger ones first."""
    size, more = F.floor(rows / levels), rows % levels
    cut = more * (size + 1)
    late = more + F.floor((position - cut) / F.greatest(size, F.lit(1)))
    return F.when(position < cut, F.floor(position / (size + 1))).otherwise(late).cast("int")

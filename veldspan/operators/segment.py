"""Cutting items into evenly spaced segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clip_segments(items: DataFrame, id_col: str, total_col: str, length: int, max_segments: int = 5, min_share: float = 0.5) -> DataFrame:
    """Rows (clip_id, name, start_sample, end_sample) for each item that is long enough.

    An item shorter than ``min_share`` of a segment gives none.  Otherwise it gives
    ``total div length`` segments, at least one and at most ``max_segments``, spread from
    its start to its end; the only segment of a short item may end after the item.
    """
    n = F.least(F.lit(max_segments), F.greatest(F.expr(f"`{total_col}` div {length}"), F.lit(1)))
    fit = items.filter(F.col(total_col) >= min_share * length).select(F.col(id_col).cast("string").alias("name"), F.col(total_col).alias("_total"), n.alias("_n"))
    step = F.when(F.col("_n") > 1, F.expr(f"(_total - {length}) div greatest(_n - 1, 1)")).otherwise(F.lit(0))
    spread = fit.withColumn("_step", step).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return spread.select(
        F.concat_ws("_", "name", "_i").alias("clip_id"),
        "name",
        (F.col("_i") * F.col("_step")).cast("long").alias("start_sample"),
        (F.col("_i") * F.col("_step") + length).cast("long").alias("end_sample"),
    )


def fixed_segment(items: DataFrame, id_col: str, length: int) -> DataFrame:
    """One segment (name_0, 0, length) per item, whatever the item's length."""
    name = F.col(id_col).cast("string")
    return items.select(F.concat(name, F.lit("_0")).alias("clip_id"), name.alias("name"), F.lit(0).cast("long").alias("start_sample"), F.lit(length).cast("long").alias("end_sample"))


def batches(items: DataFrame, pos_col: str, size: int) -> DataFrame:
    """Adds the number of the fixed-size batch that a dense position falls in."""
    return items.withColumn("batch", F.expr(f"`{pos_col}` div {size}"))

"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order and ranked; a row's fractional rank
``(2 rank + 1) / (2 rows of the source)`` spreads every source evenly over [0, 1).
Sorting all rows by it and cutting at equal counts gives shards that each hold the
mixture of the whole.  The law is ``rows``: shard sizes in rows differ by at most one.

Texts never move: ids, sizes and checksums are taken where the rows are read, and only
those narrow columns are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import group_key, materialise, running_before, seeded_unit, shuffle_width

SHARDS = 40
SEED = "shard-2024"
ROW_OVERHEAD = 16


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    order_col: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, and the columns of ``keep``.

    Null texts have no bytes (size 16, crc 0); a null source is a source of its own; a
    null id takes part like any other value.  Repeated rows are ranked one after the
    other, so every input row has its own slot.  An empty table gives an empty table.
    Other columns of the input are ignored whatever their names.  With ``order_col`` the rows of a
    source are ranked by that number (a training position; nulls first) instead of the seeded order, so a
    shard's slots follow it.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    first = F.col(order_col).cast("double") if order_col else seeded_unit(seed, F.col(id_col))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.length(raw) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).cast("long").alias("text_crc32"),
            group_key(F.col(source_col)).alias("_source"),
            first.alias("_unit"),
            *keep,
        ),
        "shard-rows",
    )
    total = rows.count()
    ties = ["_unit", "doc_id", "size", "text_crc32", *keep]
    ranked = running_before(rows, ["_source"], ties, F.lit(1), "_rank", total)
    counts = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows"))
    placed = ranked.join(counts, "_source").withColumn("_place", (2 * F.col("_rank") + 1) / (2 * F.col("_rows")))
    order = running_before(placed, [], ["_place", *ties, "_source"], F.lit(1), "_pos", total)
    shard = F.expr(f"(_pos * {shards}) div {max(total, 1)}")
    return (
        order.withColumn("_shard", shard)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("_shard").cast("int").alias("shard"),
            (F.col("_pos") - F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            *keep,
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED, files: int = 1) -> None:
    """The documents themselves, one folder per shard, in about ``files`` files a shard, each sorted by slot.

    Every input row is written once, with null and repeated ids too: rows are numbered in a
    copy in the shared folder and meet their place by that number.  Columns of the input
    named shard or slot are left out; an empty table writes an empty folder.
    """
    spark = docs.sparkSession
    own = docs.drop("shard", "slot")
    numbered = materialise(own.withColumn("_row", F.monotonically_increasing_id()), "shard-texts")
    plan = assign_shards(numbered, shards, seed, keep=("_row",)).select("_row", "shard", "slot")
    (
        numbered.join(plan.hint("merge"), "_row")
        .drop("_row")
        .repartitionByRange(max(shuffle_width(spark), shards * files), "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )

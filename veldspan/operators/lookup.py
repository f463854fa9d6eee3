"""Lookups between items, captions, scores and outputs, with explicit policies and reports of misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import with_running_sum
from .intervals import interval_join


def last_caption(captions: DataFrame, id_col: str, pos_col: str, caption_col: str) -> DataFrame:
    """One caption per id: the one that comes last."""
    return captions.groupBy(id_col).agg(F.max_by(caption_col, pos_col).alias(caption_col))


def caption_list(captions: DataFrame, id_col: str, pos_col: str, caption_col: str) -> DataFrame:
    """All captions of an id in their order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos_col), F.col(caption_col))))
    return captions.groupBy(id_col).agg(F.transform(ordered, lambda x: x[caption_col]).alias("captions"))


def attach_captions(clips: DataFrame, captions: DataFrame, name_col: str, id_col: str, pos_col: str, caption_col: str, policy: str = "last") -> DataFrame:
    """Clips joined with their captions; ``policy`` is last (one row a clip) or all (one row a caption).

    Clips without a caption are dropped; see ``without_match``.
    """
    right = last_caption(captions, id_col, pos_col, caption_col) if policy == "last" else captions
    return clips.join(right, clips[name_col] == right[id_col])


def without_match(rows: DataFrame, others: DataFrame, left: str, right: str) -> DataFrame:
    """Rows that have no partner: missing captions, outputs still to be made, misses of a listing."""
    return rows.join(others.select(F.col(right).alias("_other")).distinct(), F.col(left) == F.col("_other"), "left_anti")


def with_match(rows: DataFrame, others: DataFrame, left: str, right: str) -> DataFrame:
    return rows.join(others.select(F.col(right).alias("_other")).distinct(), F.col(left) == F.col("_other"), "left_semi")


def match_report(rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """One row: total, written (with a score) and missing rows."""
    scored = scores.select(key).distinct().withColumn("_hit", F.lit(1))
    return rows.join(scored, key, "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("_hit").alias("written"), F.count_if(F.col("_hit").isNull()).alias("missing")
    )


def override(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old records with ``columns`` taken from the new ones where these exist."""
    renamed = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(renamed, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def locate(indexes: DataFrame, sources: DataFrame, index_col: str) -> DataFrame:
    """Global index -> (source, local index) over sources laid end to end; negative indexes count from the end.

    ``sources`` has (source, ordinal, size), one row per concatenated dataset, however many; an index out of range
    finds none.
    """
    laid = with_running_sum(sources, [], [F.col("ordinal")], F.col("size").cast("long"), "start")
    total = laid.agg(F.sum("size").alias("_total"))  # one row
    spans = laid.select("source", "start", (F.col("start") + F.col("size")).alias("end"))
    at = F.when(F.col(index_col) < 0, F.col("_total") + F.col(index_col)).otherwise(F.col(index_col))
    placed = indexes.crossJoin(F.broadcast(total)).select(index_col, at.cast("long").alias("_at"))
    return interval_join(placed, spans, "_at", "start", "end").select(index_col, "source", (F.col("_at") - F.col("start")).alias("local_index"))


def padded_key(col, width: int, prefix: str = "", suffix: str = ""):
    """A composite key: prefix, number padded with zeros, suffix."""
    return F.concat(F.lit(prefix), F.lpad(col.cast("string"), width, "0"), F.lit(suffix))

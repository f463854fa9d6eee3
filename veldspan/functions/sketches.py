"""Mergeable summaries: distinct counts and quantiles kept a period and put together later, without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_BITS = 12  # standard error 1.04 / sqrt(2 ** bits): 1.6 %
KLL_SIZE = 400  # rank error about 1 / (0.55 k): 0.7 % with near certainty


def summarised(rows: DataFrame, by: list[str], distinct: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """One row for each ``by``: rows, and a sketch of each of ``distinct`` (columns of any type) and of the numbers ``values``; nulls count nowhere.

    Sketches have a fixed size whatever they have seen, are built before the shuffle and merged after it.
    """
    text = {name: F.hll_sketch_agg(c.cast("string"), HLL_BITS) for name, c in distinct.items()}
    numbers = {name: F.kll_sketch_agg_double(c.cast("double"), F.lit(KLL_SIZE)) for name, c in values.items()}
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[s.alias(name) for name, s in {**text, **numbers}.items()])


def merged(summaries: DataFrame, by: list[str], distinct: list[str], values: list[str]) -> DataFrame:
    """The summaries of ``summarised`` put together for the coarser ``by`` (which may be empty)."""
    sketches = [F.hll_union_agg(name).alias(name) for name in distinct] + [F.kll_merge_agg_double(name).alias(name) for name in values]
    return summaries.groupBy(*by).agg(F.sum("rows").alias("rows"), *sketches)


def distinct_estimate(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_estimate(sketch: str, at: float) -> Column:
    """A value whose share of smaller ones is near ``at``."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(at))


def rank_estimate(sketch: str, value: float) -> Column:
    """About the share of values up to ``value``."""
    return F.kll_sketch_get_rank_double(sketch, F.lit(value))

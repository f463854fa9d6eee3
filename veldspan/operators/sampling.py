"""Repeatable sampling, shuffling, dropout and oversampling, ordered by md5 of a seed and a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import equal_frequency, seeded_unit, with_position


def sample_exactly(rows: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """``n`` rows (all, if there are fewer) drawn uniformly: those with the smallest seeded numbers."""
    placed = with_position(rows.withColumn("_u", seeded_unit(seed, F.col(key))), "_u", key, name="_pos")
    return placed.filter(F.col("_pos") < n).drop("_u", "_pos")


def shuffled_shards(rows: DataFrame, epoch: int, world: int, key: str) -> DataFrame:
    """Adds ``pos`` in the epoch's seeded order and ``shard``, the process that takes it in turn."""
    placed = with_position(rows.withColumn("_u", seeded_unit(f"epoch{epoch}", F.col(key))), "_u", key)
    return placed.drop("_u").withColumn("shard", F.pmod("pos", F.lit(world)).cast("int"))


def dropped(key: Column, seed: str, share: float) -> Column:
    """A repeatable Bernoulli mask."""
    return seeded_unit(seed, key) < share


def levels(rows: DataFrame, order: str, tie: str, count: int = 10, name: str = "q_level") -> DataFrame:
    """Adds equal-frequency levels 0..count-1 in the order of a numeric column."""
    placed = with_position(rows, order, tie, name="_pos", total="_rows")
    return placed.withColumn(name, equal_frequency(F.col("_pos"), F.col("_rows"), count)).drop("_pos", "_rows")


def concatenated(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """UNION ALL of tables, each repeated some times, with the number of the source and of the repeat."""
    repeated = [
        df.withColumn("source", F.lit(i)).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) for i, (df, times) in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, repeated)


def first_rows(rows: DataFrame, order: list[str], n: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` in an order that tells all rows apart; n of -1 takes all that follow."""
    ordered = rows.orderBy(*order).offset(offset)
    return ordered if n < 0 else ordered.limit(n)

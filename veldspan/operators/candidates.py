"""Choosing among the candidates of a group, and group similarity without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalised


def group_sums(members: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, sums, members): the sum of unit vectors, element by element, aggregated map-side."""
    unit = members.select(group, F.posexplode(normalised(F.col(vector))).alias("_i", "_v"))
    parts = unit.groupBy(group, "_i").agg(F.sum("_v").alias("_s"))
    sums = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias("sums"))
    return sums.join(members.groupBy(group).agg(F.count(F.lit(1)).alias("members")), group)


def consensus(members: DataFrame, group: str, vector: str) -> DataFrame:
    """Adds ``consensus``: the mean cosine of a member to the others of its group.

    With unit vectors u and their sum S, the cosines of u to the others add up to u.S - 1,
    so no pairs are formed.  Null for the only member of a group.
    """
    sums = group_sums(members, group, vector)
    unit = members.withColumn("_u", normalised(F.col(vector)))
    total = F.aggregate(F.zip_with("_u", "sums", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    joined = unit.join(sums, group)
    return joined.withColumn("consensus", F.round(F.try_divide(total - 1, F.col("members") - 1), 6)).drop("_u", "sums", "members")


def mean_similarity(members: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, members, mean_similarity): the mean cosine of all pairs, (|S|^2 - n) / (n (n - 1))."""
    square = F.aggregate("sums", F.lit(0.0), lambda s, v: s + v * v)
    n = F.col("members")
    return group_sums(members, group, vector).select(group, "members", F.round(F.try_divide(square - n, n * (n - 1)), 6).alias("mean_similarity"))


def pick_one(members: DataFrame, group: str, score: Column, tie: str, best: bool = True) -> DataFrame:
    """One member per group: the best (or worst) score, then the smallest ``tie``; one aggregate, no sort."""
    key = F.struct((score if best else -score).alias("s"), (-F.col(tie)).alias("t"))
    return members.groupBy(group).agg(F.max_by(F.struct(*members.columns), key).alias("_m")).select("_m.*")


def pick_random(members: DataFrame, group: str, key: Column, seed: str) -> DataFrame:
    """One member per group by the smallest md5 of seed and key: the same on every run."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return members.groupBy(group).agg(F.min_by(F.struct(*members.columns), order).alias("_m")).select("_m.*")

"""Verification of shards against a manifest, from file footers; only bad shards are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch


def write_sharded(rows: DataFrame, path: str, shard: str, key: str) -> None:
    """One folder ``shard=N`` a shard, rows sorted by key within files."""
    rows.repartition(shard).sortWithinPartitions(shard, key).write.partitionBy(shard).parquet(path)


def manifest_of(rows: DataFrame, shard: str, key: str) -> DataFrame:
    """(shard, rows, low, high): what a shard is to hold."""
    return rows.groupBy(F.col(shard).cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))


def footer_counts(spark: SparkSession, path: str, shard: str, key: str) -> DataFrame:
    """(shard, rows, low, high) as the Parquet footers tell, without reading a page of data.

    The aggregate is pushed into the scan, in a session of its own with that rule on; its few rows a file are
    written to the shared folder and read in the caller's session.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    for name in ("spark.checkpoint.dir", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None and own.conf.isModifiable(name):
            own.conf.set(name, value)
    found = own.read.parquet(path).groupBy(shard).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
    out = scratch(spark, "footers")
    found.withColumnRenamed(shard, "shard").withColumn("shard", F.col("shard").cast("long")).write.parquet(out)
    return spark.read.parquet(out)


def verify_shards(spark: SparkSession, path: str, manifest: DataFrame, shard: str, key: str) -> DataFrame:
    """(shard, status, rows, expected, distinct_keys) of every shard of manifest or folder.

    status is ok, missing, unexpected, short, long, bounds (as many rows, other keys at the ends) or repeated (the
    bounds of another shard's keys); distinct_keys is counted, from the data, for bad shards alone and null for others.
    """
    found = footer_counts(spark, path, shard, key)
    want = manifest.select("shard", F.col("rows").alias("expected"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    both = want.join(found, "shard", "full")
    # a shard is another's copy where its bounds are those that the manifest gives to that one
    owner = want.select(F.col("shard").alias("_owner"), F.col("_low").alias("low"), F.col("_high").alias("high"))
    both = both.join(owner, ["low", "high"], "left").withColumn("_copy", F.col("_owner").isNotNull() & ~F.col("_owner").eqNullSafe(F.col("shard")))
    same_ends = F.col("low").eqNullSafe(F.col("_low")) & F.col("high").eqNullSafe(F.col("_high"))
    status = (
        F.when(F.col("rows").isNull(), "missing")
        .when(F.col("_copy"), "repeated")
        .when(F.col("expected").isNull(), "unexpected")
        .when(F.col("rows") < F.col("expected"), "short")
        .when(F.col("rows") > F.col("expected"), "long")
        .when(~same_ends, "bounds")
        .otherwise("ok")
    )
    judged = both.groupBy("shard").agg(F.max_by(status, F.col("_copy").cast("int")).alias("status"), F.first("rows").alias("rows"), F.first("expected").alias("expected"))
    bad = [r[0] for r in judged.filter("status NOT IN ('ok', 'missing')").select("shard").collect()]  # the list of bad shards, as a pruning filter
    data = spark.read.parquet(path).filter(F.col(shard).isin(bad)).groupBy(F.col(shard).cast("long").alias("shard")).agg(F.countDistinct(key).alias("distinct_keys"))
    return judged.join(data, "shard", "left")

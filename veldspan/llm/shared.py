"""Helpers that several corpus operators use: checkpoints, seeded order, ranks without a hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import scratch
from ..workers import workers_find_package

RANGE_ROWS = 1_000_000  # rows of a range that are sorted in one task


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return scratch(spark, name)


def materialise(df: DataFrame, name: str, path: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors.

    Bytes that are compressed already go with ``compression`` none: the codec would hold whole pages of them outside the heap.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def seeded_unit(seed: str, *cols: Column) -> Column:
    """A repeatable number in [0, 1) from the md5 of seed and columns; the same in any SQL engine."""
    text = F.concat(F.lit(f"{seed}:"), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def group_key(col: Column) -> Column:
    """A string that is never null and tells null from every text."""
    return F.when(col.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), col.cast("string")))


def running_before(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, rows: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows (``rows`` in all) of the group that come before this row in ``order``."""
    return running_sums(df, group, order, {out: value}, rows)


def running_sums(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], rows: int) -> DataFrame:
    """Adds for each of ``values`` its sum over the rows (``rows`` in all) of the group that come before this row in ``order``.

    A window over a whole group would send a hot group to one task.  Here rows are
    range-sorted by group, order and a number of their own, so that neither a hot group nor
    rows alike in all of ``order`` can fill a range; a small table holds what each range adds up
    to, and only the rows of one range meet in a window.  Rows alike in group and order are
    told apart by where they stand in the input.
    """
    spark = df.sparkSession
    width = max(shuffle_width(spark), -(-rows // RANGE_ROWS))
    inputs = {f"_value_{out}": value for out, value in values.items()}
    numbered = df.withColumns(inputs).withColumn("_twin", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(width, *group, *order, "_twin").withColumn("_range", F.spark_partition_id())
    cut = materialise(ranged, "ranges")
    sums = cut.groupBy(*group, "_range").agg(*[F.sum(f"_value_{out}").alias(f"_sum_{out}") for out in values])
    over = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*group, "_range", *[F.coalesce(F.sum(f"_sum_{out}").over(over), F.lit(0)).alias(f"_before_{out}") for out in values])
    inside = Window.partitionBy(*group, "_range").orderBy(*order, "_twin").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = {out: (F.col(f"_before_{out}") + F.coalesce(F.sum(f"_value_{out}").over(inside), F.lit(0))).cast("long") for out in values}
    return cut.join(before, [*group, "_range"]).withColumns(sum_before).drop("_range", "_twin", *inputs, *[f"_before_{out}" for out in values])


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string, as mapInArrow expects it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_text(df: DataFrame, ddl: str, task, rows: int = 4096, limit: int | None = None) -> DataFrame:
    """Runs ``task`` over slices of the first column (a text), a few megabytes (or ``limit`` bytes) at a time.

    ``task`` is called once per Spark task and returns (each, last): ``each(slice, rest)``
    gives the columns to emit for one slice (or None), ``rest`` being the other columns'
    arrays for its rows; ``last()``, if not None, gives what the task emits at its end.
    """
    from . import kernel

    workers_find_package(df.sparkSession)
    schema = arrow_schema(ddl)

    def run(batches):
        each, last = task()
        for batch in batches:
            for piece in kernel.text_slices(batch.column(0), limit or kernel.SLICE_BYTES, rows):
                rest = [batch.column(i).slice(piece.lo, piece.hi - piece.lo) for i in range(1, batch.num_columns)]
                out = each(piece, rest)
                if out is not None:
                    yield kernel.table(out, schema)
        if last is not None:
            out = last()
            if out is not None:
                yield kernel.table(out, schema)

    return df.mapInArrow(run, ddl)

"""Writers: delimited tables, feature records, metrics, series, versioned snapshots and run markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_delimited(rows: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> None:
    """A folder of delimited files with headers; quotes inside values are doubled."""
    rows.write.csv(path, sep=sep, header=True, escape='"', mode=mode)


def write_features(rows: DataFrame, path: str, key: str = "idx") -> None:
    """Feature records as Parquet rows sorted by key within files, instead of a file for each record."""
    rows.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_arrays(rows: DataFrame, path: str, key: str, arrays: dict[str, str]) -> None:
    """Records as the bytes of NPZ archives (name -> column of ``arrays``), one a row beside its key, instead of a file each."""
    import io

    import numpy as np
    import pandas as pd

    def pack(frames):
        for frame in frames:
            content = []
            for values in zip(*(frame[c] for c in arrays.values())):
                out = io.BytesIO()
                np.savez(out, **{n: np.asarray(v, float) for n, v in zip(arrays, values) if v is not None})
                content.append(out.getvalue())
            yield pd.DataFrame({"id": frame[key].astype(str), "content": content})

    rows.select(key, *arrays.values()).mapInPandas(pack, "id string, content binary").write.mode("overwrite").parquet(path)


def write_entities(rows: DataFrame, path: str, key: str = "id") -> None:
    """One JSON object of the other columns an entity, a row beside its key instead of a file each."""
    rest = [c for c in rows.columns if c != key]
    rows.select(F.col(key).cast("string").alias("id"), F.to_json(F.struct(*rest)).alias("content")).write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A small report: one JSON object of key -> value, keys in order.  Use ``write_metric_lines`` for tables that grow."""
    metrics.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_metric_lines(metrics: DataFrame, path: str) -> None:
    """``{"key": ..., "value": ...}`` lines sorted by key over the files, of any number of metrics."""
    metrics.select("key", "value").repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").json(path)


def append_series(points: DataFrame, path: str) -> None:
    points.write.mode("append").parquet(path)


def write_version(rows: DataFrame, root: str, number: int) -> str:
    """A snapshot under its own version; readers of earlier versions are not disturbed."""
    path = f"{root}/version={number}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.parquet(root)
    return rows.filter(F.col("version") == rows.agg(F.max("version")).first()[0]).drop("version")


def rotate(rows: DataFrame, root: str, keep: int = 2) -> int:
    """Writes the next version and drops all but the ``keep`` newest (the last and its shadow); returns its number."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    have = sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(at) if f.getPath().getName().startswith("version=")) if files.exists(at) else []
    number = have[-1] + 1 if have else 0
    write_version(rows, root, number)
    for old in have[: len(have) + 1 - keep]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version={old}"), True)
    return number


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Adds alert rows to a table, stamped with the time; nothing is sent anywhere."""
    alerts.withColumn("raised_at", F.current_timestamp()).write.mode("append").parquet(path)


def fingerprint(rows: DataFrame) -> str:
    """The same for equal multisets of rows, whatever their order."""
    parts = rows.select(F.xxhash64(*rows.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{parts.n}:{parts.s}"


def already_done(spark: SparkSession, marker: str, **run) -> bool:
    """Whether a marker written by ``mark_done`` tells of the same run."""
    try:
        rows = spark.read.json(marker).collect()
    except Exception as error:  # noqa: BLE001  Spark tells a missing path by its error class only
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return [r.asDict() for r in rows] == [run]


def mark_done(spark: SparkSession, marker: str, **run) -> None:
    spark.createDataFrame([run]).coalesce(1).write.mode("overwrite").json(marker)

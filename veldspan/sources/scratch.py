"""Where jobs write what they read again: the folder all executors share."""

from __future__ import annotations

import re
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset the warehouse; the settings are only read.

    A warehouse in a local folder is only shared where driver and executors are one process; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    root = spark.conf.get("spark.sql.warehouse.dir")
    scheme = urlparse(root).scheme or urlparse(spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    if scheme == "file" and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"executors do not share {root}: set spark.checkpoint.dir to a folder that they share")
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/veldspan/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage is cut and survives lost executors."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

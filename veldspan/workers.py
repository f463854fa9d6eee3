"""Python workers must be able to import this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed but lies in a folder they see."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])

"""The corpus pipeline: five stages over the documents table, each applying one corpus operator.

A stage takes (spark, docs, sf_dir), docs being what the stage before kept; its result is
written as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.  An empty table gives an empty table in every stage; columns that a stage
does not read are handed on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldspan.llm import decontamination, jaccard_join, mixing, quality_classifier, sharding
from veldspan.llm.shared import discard, materialise, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps.

    Null, empty and blank texts are judged like others; rows alike in id are judged one by one; repeated rows are all
    kept or all dropped; a null id has no label.
    """
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, the one with the smallest id.

    Of null ids only, one row; rows alike in id and words are one; rows without words link with nothing and all stay.
    """
    return jaccard_join.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exactly or within the error budget.

    Null and empty texts hold none, null and empty items are in none; repeated rows stay or go together.
    """
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in training order.

    A null source is a source; rows alike in id have the copies of their own; documents without words are left out.
    """
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix; null and repeated ids and null texts have places of their own."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: SQL can express neither the classifier nor edit matching; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's input is deleted from the shared folder once the next table is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{number}", path := scratch_path(spark, f"pipeline-{number}"))
            if before:
                discard(spark, before)
            before = path
    return docs

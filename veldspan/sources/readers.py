"""Readers with explicit schemas; a path may be anything Spark reads, and order is kept as ``pos`` where it is identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPTIONS = "id STRING, caption STRING"
CLIPS = "id STRING, name STRING, start_sample BIGINT, end_sample BIGINT"
LABELS = "id STRING, label STRING"
SPLITS = "id STRING, sec INT, caption STRING, split STRING"
NAMED_CAPTIONS = "name STRING, caption STRING"
ALIGNMENT = "idx BIGINT, clip_id STRING, npz_fname STRING"
SIMILARITY = "id STRING, clap_sim DOUBLE"
DEFAULT_LEVEL = 9
NULL_LEVEL = 10


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """A delimited table; quotes inside values are doubled, ids stay strings with their zeros."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, escape='"')


def read_tolerant(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): lines that do not fit the schema are kept apart, not lost."""
    rows = spark.read.csv(path, schema=f"{schema}, _corrupt STRING", sep=sep, header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True)
    # Spark parses only the columns that a plan reads, and a line is found bad only by a column that is parsed
    seen = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in rows.columns if c != "_corrupt"])) >= 0
    return rows.filter("_corrupt IS NULL").filter(seen).drop("_corrupt"), rows.filter("_corrupt IS NOT NULL").filter(seen).withColumnRenamed("_corrupt", "line")


def read_manifest(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """A training manifest (id, caption, q_level); the level column may be missing (then 9) or forced."""
    names = spark.read.csv(path, sep="\t", header=True, escape='"').columns
    rows = spark.read.csv(path, schema=", ".join(f"`{n}` STRING" for n in names), sep="\t", header=True, escape='"')
    q = F.lit(level) if level is not None else F.coalesce(F.col("q_level").cast("int"), F.lit(DEFAULT_LEVEL)) if "q_level" in names else F.lit(DEFAULT_LEVEL)
    return rows.select("id", "caption", q.alias("q_level"))


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines id -> similarity; of repeated ids the last line counts."""
    lines = read_lines(spark, path)
    parsed = lines.select("pos", F.from_json("line", SIMILARITY).alias("x")).select("pos", "x.*")
    return parsed.groupBy("id").agg(F.max_by("clap_sim", "pos").alias("clap_sim"))


def read_entities(spark: SparkSession, folder: str, field: str = "audio_prompt") -> DataFrame:
    """One JSON object per file, keyed by the file's stem."""
    rows = spark.read.json(folder, schema=f"`{field}` STRING", multiLine=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("id"), F.col(field))


def read_packed_entities(spark: SparkSession, folder: str, field: str = "audio_prompt") -> DataFrame:
    """(id, field) of the objects that ``write_entities`` has packed; a missing field is null."""
    rows = spark.read.schema("id STRING, content STRING").parquet(folder)
    return rows.select("id", F.from_json("content", f"`{field}` STRING")[field].alias(field))


def read_documents(spark: SparkSession, path: str, schema: str = "path STRING") -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): trimmed lines that are not blank, numbered in the order of file names and of lines in a file.

    Splits of a file are read in order; Spark may pack files in any order, so files are
    ordered by name and splits by where they start in the file.
    """
    at = F.struct("_metadata.file_path", "_metadata.file_block_start")
    lines = spark.read.text(path).select(F.trim("value").alias("line"), at.alias("_part"), F.monotonically_increasing_id().alias("_at")).filter(F.length("line") > 0)
    counts = lines.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    return lines.join(before, "_part").select((F.col("_before") + inside).cast("long").alias("pos"), "line")


def sequence_names(spark: SparkSession, n: int, suffix: str = ".npz") -> DataFrame:
    """(pos, name): 0.npz .. n-1.npz."""
    return spark.range(n).select(F.col("id").alias("pos"), F.concat(F.col("id").cast("string"), F.lit(suffix)).alias("name"))


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("wav", "flac")) -> DataFrame:
    """(path, stem, size, modified) of the files with one of the extensions, by path; contents are not read."""
    rows = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    kept = rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).orderBy("path")
    return kept.select("path", stem.alias("stem"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def newest_log(spark: SparkSession, folder: str, last: int = 120) -> DataFrame:
    """The last lines of the newest file of a folder."""
    newest = list_files(spark, folder, ("log", "txt")).orderBy(F.desc("modified"), "path").limit(1).first()
    if newest is None:
        return spark.createDataFrame([], "pos long, line string")
    return read_lines(spark, newest["path"]).orderBy(F.desc("pos")).limit(last)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``key: value`` lines."""
    line = read_lines(spark, path)
    key, value = F.regexp_extract("line", r"^(\w+):", 1), F.regexp_extract("line", r"^\w+:\s*(-?[0-9.eE+-]+)", 1)
    return line.select(key.alias("key"), value.try_cast("double").alias("value")).filter("key <> '' AND value IS NOT NULL")


def read_partials(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """Partial tables that ranks wrote under ``root`` (rank=0, rank=1, ...), with their rank, and file and place of each row."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(root)
    place = F.struct(F.regexp_extract("_metadata.file_path", "([^/]+)$", 1).alias("name"), F.col("_metadata.row_index").alias("row"))
    return rows.select("*", place.alias("_place"))


def combined(partials: DataFrame) -> DataFrame:
    """Adds ``pos``: the place of each row in the order of ranks, names of files and rows in a file.  No task holds a rank."""
    from ..functions.ordering import with_position

    return with_position(partials.withColumn("_at", F.struct(F.col("rank").cast("long"), "_place")), "_at").drop("_at", "_place")


def read_arrays(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """(id, one flat array of doubles per name) of NPZ records, one file each; a missing name is null."""
    import io

    import numpy as np
    import pandas as pd

    def unpack(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as record:
                    rows.append([path.rsplit("/", 1)[-1].removesuffix(".npz"), *(record[n].astype(float).reshape(-1).tolist() if n in record else None for n in names)])
            yield pd.DataFrame(rows, columns=["id", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select("path", "content")
    return files.mapInPandas(unpack, ", ".join(["id string", *(f"`{n}` array<double>" for n in names)]))


def read_packed_arrays(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """(id, one flat array of doubles per name) of records that ``write_arrays`` has packed; a missing name is null."""
    import io

    import numpy as np
    import pandas as pd

    def unpack(frames):
        for frame in frames:
            rows = []
            for key, content in zip(frame["id"], frame["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as record:
                    rows.append([key, *(record[n].astype(float).reshape(-1).tolist() if n in record else None for n in names)])
            yield pd.DataFrame(rows, columns=["id", *names])

    return spark.read.parquet(folder).select("id", "content").mapInPandas(unpack, ", ".join(["id string", *(f"`{n}` array<double>" for n in names)]))

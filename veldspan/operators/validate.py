"""Checks of tables against each other and against expectations; each returns its findings as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_mismatches(expected: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of the full outer join on ``key`` whose columns differ, with both sides."""
    left = expected.select(key, F.lit(True).alias("_left"), *[F.col(c).alias(f"expected_{c}") for c in columns])
    right = found.select(key, F.lit(True).alias("_right"), *[F.col(c).alias(f"found_{c}") for c in columns])
    same = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    for c in columns:
        same = same & F.col(f"expected_{c}").eqNullSafe(F.col(f"found_{c}"))
    return left.join(right, key, "full_outer").filter(~same).drop("_left", "_right")


def manifest_verdict(expected: DataFrame, found: DataFrame | None, key: str, columns: list[str]) -> str:
    """write (no manifest yet), length (row counts differ), mismatch, or ok."""
    if found is None:
        return "write"
    if expected.count() != found.count():
        return "length"
    return "mismatch" if manifest_mismatches(expected, found, key, columns).limit(1).count() else "ok"


def first_mismatches(expected: DataFrame, found: DataFrame, key: str, columns: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` mismatches by key."""
    return manifest_mismatches(expected, found, key, columns).orderBy(key).limit(n)


def parsed_lines(lines: DataFrame, line: str, names: list[str], sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(columns of lines with the right number of fields, the other lines)."""
    cut = lines.withColumn("_parts", F.split(F.rtrim(line), sep))
    fits = F.size("_parts") == len(names)
    good = cut.filter(fits).select(*[F.trim(F.col("_parts")[i]).alias(n) for i, n in enumerate(names)])
    return good, cut.filter(~F.coalesce(fits, F.lit(False))).select(line)


def required_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """(column, present, filled): whether each is there, and whether all rows have a value in it; one pass, one row a column."""
    there = [n for n in names if n in rows.columns]
    counts = rows.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(n)).alias(f"_{i}") for i, n in enumerate(there)])
    filled = {n: F.col(f"_{i}") == F.col("_rows") for i, n in enumerate(there)}
    told = [F.struct(F.lit(n).alias("column"), F.lit(n in there).alias("present"), filled.get(n, F.lit(False)).alias("filled")) for n in names]
    return counts.select(F.explode(F.array(*told)).alias("x")).select("x.*")


def changed_columns(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, same, changed) over the keys of both tables."""
    pairs = old.select(key, *[F.col(c).alias(f"old_{c}") for c in columns]).join(new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns]), key)
    same = lambda c: F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    counts = pairs.agg(*[F.struct(F.count_if(same(c)).alias("same"), F.count_if(~same(c)).alias("changed")).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.same").alias("same"), F.col(f"{c}.changed").alias("changed")) for c in columns])).alias("x")).select("x.*")


def completeness(rows: DataFrame, by: str, expected: int) -> DataFrame:
    """(by, found, complete): whether each group has as many rows as expected."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("found")).withColumn("complete", F.col("found") == expected)


def gathered(wanted: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The records of the wanted keys; a key that has several records, or none, is an error raised where it is met."""
    once = records.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in records.columns if c != key])).alias("_record"))
    met = wanted.join(once, key, "left")
    checked = F.when(F.col("_n") == 1, F.col("_record")).otherwise(F.raise_error(F.concat(F.lit("not one record for "), F.col(key).cast("string"))))
    return met.withColumn("_record", checked).select(*wanted.columns, "_record.*")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def wrong_size(rows: DataFrame, array: str, size: int) -> DataFrame:
    """Rows whose array is null or has another size."""
    return rows.filter(F.col(array).isNull() | (F.size(array) != size))


def shared_lines(texts: DataFrame, others: DataFrame, id_a: str, id_b: str, text: str, least: int = 40) -> DataFrame:
    """(id_a, id_b, lines): distinct lines of at least ``least`` characters that both texts have, by equality of lines."""

    def lines(df: DataFrame, name: str) -> DataFrame:
        split = df.select(F.col(name), F.explode(F.split(text, "\n")).alias("_line"))
        return split.filter(F.length("_line") >= least).select(name, F.md5("_line").alias("_line")).distinct()

    return lines(texts, id_a).join(lines(others, id_b), "_line").groupBy(id_a, id_b).agg(F.count(F.lit(1)).alias("lines"))

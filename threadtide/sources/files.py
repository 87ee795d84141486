"""Readers and writers: nested threads, CSV, table snapshots, partitioned outputs and text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadtide.sources.schemas import JSON_DEPTH, NODE

CORRUPT = "_corrupt_record"


def read_threads(spark: SparkSession, path: str, multi_line: bool = True, author_from_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """Posts of all thread files below ``path`` and the records that could not be read.

    A file holds one post or an array of posts (or one post per line with ``multi_line`` off). The author
    is the file's name without its ending, or a partition folder ``author_id=...``. Replies are read as JSON
    text, whatever their depth. Returns (posts, bad): bad has the file and the offending text; empty objects
    are skipped.
    """
    schema = T.StructType(NODE.fields + [T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).options(**JSON_DEPTH).json(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    return split_bad(raw, author_from_file)


def split_bad(raw: DataFrame, author_from_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good and bad records of a permissive read.

    Bad are also posts whose replies are no list, or nest deeper than the JSON writer goes (about 500 levels
    of replies): they are recorded, not cut.
    """
    # the reader refuses plans that need nothing but the corrupt column, so a data column stays in the filter
    held = F.length(F.concat_ws("", "username", "link")) >= 0
    lost = F.col("replies_content").isNotNull() & F.from_json("replies_content", "array<string>", JSON_DEPTH).isNull()
    bad = raw.where((F.col(CORRUPT).isNotNull() | lost) & held).select(
        F.regexp_extract("_file", r"([^/]+)$", 1).alias("file"),
        F.coalesce(CORRUPT, "replies_content").alias("error"))
    empty = F.lit(True)
    for name in ("username", "content", "link", "replies_content"):
        empty = empty & F.col(name).isNull()
    posts = raw.where(F.col(CORRUPT).isNull() & ~lost & ~empty).drop(CORRUPT)
    if author_from_file:
        posts = posts.withColumn("author_id", F.regexp_extract("_file", r"([^/]+)\.json$", 1))
    return posts, bad


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a header and a fixed column order; quotes doubled, line breaks kept."""
    df.select(*columns).write.mode("errorifexists").option("escape", '"').option("quoteAll", True).csv(path, header=True)


def broken_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files below ``path`` in which no quoted field can hold a line break, and the others. A field that goes on in
    the next line leaves an odd number of quotes in the line it begins in; doubled quotes do not change parity."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), (F.length(F.regexp_replace("value", '[^"]', "")) % 2).alias("odd"))
    found = lines.groupBy("file").agg(F.max("odd").alias("odd")).orderBy("file").collect()  # a row per file
    return [r["file"] for r in found if not r["odd"]], [r["file"] for r in found if r["odd"]]


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with header, quotes, embedded commas and line breaks; only the wanted columns are parsed.

    A file with quoted line breaks can only be read from its start, by one task. Files proven to have none, by a
    scan of their lines, are cut into parts like any text.
    """
    reader = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
    whole, broken = broken_files(spark, path)
    parts = [reader.option("multiLine", multi).csv(files) for multi, files in ((False, whole), (True, broken)) if files]
    if not parts:
        parts = [spark.createDataFrame([], schema)]
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return df.select(*columns) if columns else df


def write_snapshot(df: DataFrame, path: str) -> None:
    """A table snapshot."""
    df.write.mode("errorifexists").parquet(path)


def nested_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a snapshot can become CSV."""
    nested = set(nested_columns(df))
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def scalar_columns(df: DataFrame) -> DataFrame:
    """The table without its nested columns."""
    nested = set(nested_columns(df))
    return df.select(*[c for c in df.columns if c not in nested])


def write_grid(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder per parameter combination."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_lines(df: DataFrame, text: str, path: str) -> None:
    """One text per line, its own line breaks turned to blanks."""
    df.select(F.regexp_replace(text, r"\R", " ").alias("value")).write.mode("errorifexists").text(path)

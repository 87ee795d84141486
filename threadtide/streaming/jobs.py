"""Incremental jobs: new thread files, rows to be scored, and running dashboard totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadtide.functions import clean as cl
from threadtide.functions import text as tx
from threadtide.operators.threads import flatten_threads
from threadtide.sources.files import CORRUPT, split_bad
from threadtide.sources.schemas import JSON_DEPTH, NODE


def ingest_threads(spark: SparkSession, source: str, sink: str, checkpoint: str, multi_line: bool = True,
                   author_from_file: bool = True, bad_sink: str | None = None) -> None:
    """ST1/S8: flatten, feature and tidy the thread files that are new since the last run.

    The checkpoint records finished files and every batch overwrites its own folder, so each file lands
    exactly once however often the job is started. Records that cannot be read go to ``bad_sink`` (by default
    the sink's name with ``.bad``) with their file.
    """
    fields = [*NODE.fields, T.StructField(CORRUPT, T.StringType())]
    if not author_from_file:
        fields.append(T.StructField("author_id", T.StringType()))
    raw = (
        spark.readStream.schema(T.StructType(fields)).option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", CORRUPT).options(**JSON_DEPTH).json(source)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    c = F.col("content")
    features = tx.comment_features(c, F.col("username"), F.col("parent_username"))

    def save(batch: DataFrame, batch_id: int) -> None:
        posts, bad = split_bad(batch, author_from_file)
        bad.write.mode("overwrite").parquet(f"{bad_sink or sink + '.bad'}/batch={batch_id}")
        flatten_threads(posts).select(
            "author_id", "id", "username", "parent_id", "content",
            *[f.alias(k) for k, f in features.items()],
            cl.tidy(cl.mark_links(cl.transliterate(cl.not_null(c)))).alias("tidied"),
        ).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = (
        raw.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ingested_total(spark: SparkSession, sink: str) -> DataFrame:
    """Rows in the sink after the run."""
    return spark.read.parquet(sink).agg(F.count("*").alias("rows"))


def label_stream(rows: DataFrame, score: Callable[[DataFrame], DataFrame], text: str, sink: str,
                 checkpoint: str) -> None:
    """ST2: score the rows of a stream as they arrive. Each batch overwrites its own folder, so a batch
    that is repeated after a failure does not appear twice. Blank texts are skipped."""

    def save(batch: DataFrame, batch_id: int) -> None:
        todo = batch.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
        score(todo).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = (
        rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def running_totals(rows: DataFrame, sink: str, checkpoint: str) -> None:
    """ST3: dashboard counts per sentiment kept current; the state is one row per label."""
    totals = rows.groupBy("sentiment_label").agg(
        F.count("*").alias("comments"),
        F.count_if(F.col("hate_label") == "HATE").alias("hate_comments"),
        F.count_if(F.col("offensive_label") == "offensive").alias("offensive_comments"),
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/v={batch_id}")

    query = (
        totals.writeStream.foreachBatch(save).outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_totals(spark: SparkSession, sink: str) -> DataFrame:
    """ST3: the newest version of the totals."""
    every = spark.read.parquet(sink)
    return every.where(F.col("v") == every.agg(F.max("v")).scalar()).drop("v")

"""A training corpus from raw documents: each stage applies one operator to all that its predecessor kept.

Rows travel as one struct beside the columns a stage adds, so that columns of the documents can have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadtide.llm import decontam, langid, mixing, simhash, tokens
from threadtide.session import bounded_batches, cut_lineage

#: A document is rejected when no language is found or the calibrated probability of the best is lower.
LEAST_LANGUAGE_SCORE = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _row(docs: DataFrame) -> Column:
    return F.struct(*[docs[c] for c in docs.columns])


def _small_batches(stage: Stage) -> Stage:
    """Whole documents go through Python in every stage, in batches that leave an executor its memory."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; NULL texts and texts without letters go."""
    told = langid.identify(docs, langid.fit(docs), _row(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates by SimHash, with the smallest id."""
    return simhash.first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, in order or in pieces."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean(docs, benchmark, _row(docs)).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it."""
    mixed = mixing.mix(docs, _row(docs))
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns where every stretch of every document stands."""
    return tokens.training_order(docs)


STAGES: list[tuple[str, Stage]] = [(name, _small_batches(stage)) for name, stage in [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mixture),
    ("token_output", training_order),
]]

#: SQL can neither fit the classifier nor tokenise; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs

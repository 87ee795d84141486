"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. A batch's line hashes are counted (one count per document that holds the line) and
written as a sorted run of level 0. When a level holds ``fanout`` runs they are merged into one run of the next
level; lines that have reached ``min_docs`` documents leave as a settled run. A later batch is anti-joined with
the settled runs before its own counts are added, so a settled line is never counted again. After the last batch
all runs are merged once more. Lines are then dropped from the documents that hold them.

Edge cases: a NULL or empty text is one empty line; an empty key is never dropped; repeated rows count as
documents of their own and are treated alike; a text of any number of lines is one row; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtide.session import cut_lineage

MIN_DOCS, BATCHES, FANOUT = 10, 4, 2
BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), ascii_uppercase, ascii_lowercase)


def digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def _run(counts: DataFrame) -> DataFrame:
    return cut_lineage(counts.sortWithinPartitions("h"))


def _merged(runs: list[DataFrame]) -> DataFrame:
    whole = runs[0]
    for run in runs[1:]:
        whole = whole.unionByName(run)
    return whole.groupBy("h").agg(F.sum("n").alias("n"))


def settled_lines(lines: DataFrame, batches: int, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> DataFrame:
    """The hashes ``h`` found in at least ``min_docs`` documents; ``lines`` has ``h`` once per document, ``batch``."""
    levels: list[list[DataFrame]] = [[]]
    settled: list[DataFrame] = []
    for batch in range(batches):
        counts = lines.where(F.col("batch") == batch).groupBy("h").agg(F.count("*").alias("n"))
        for run in settled:
            counts = counts.join(run.hint("merge"), "h", "left_anti")
        levels[0].append(_run(counts))
        level = 0
        while len(levels[level]) >= fanout:
            merged = _run(_merged(levels[level]))
            levels[level] = []
            settled.append(_run(merged.where(F.col("n") >= min_docs).select("h")))
            if len(levels) == level + 1:
                levels.append([])
            levels[level + 1].append(merged.where(F.col("n") < min_docs))
            level += 1
        if len(settled) > fanout:
            whole = settled[0]
            for run in settled[1:]:
                whole = whole.unionByName(run)
            settled = [_run(whole.distinct())]
    last = [run for level in levels for run in level]
    whole = _merged(last).where(F.col("n") >= min_docs).select("h")
    for run in settled:
        whole = whole.unionByName(run)
    return _run(whole.distinct())


def drop_common_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and the ``text`` without lines found in ``min_docs`` documents."""
    text = F.coalesce("text", F.lit(""))
    keys = F.array_distinct(F.filter(F.transform(split_lines(F.col("text")), line_key), lambda k: k != ""))
    lines = cut_lineage(
        docs.select(
            digest(text).alias("text_key"),
            F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
            F.explode(keys).alias("key"),
        ).select("batch", "text_key", digest(F.col("key")).alias("h"))
    )
    common = settled_lines(lines, batches, min_docs, fanout)
    # what a text loses depends on the text alone, so equal texts share one row of hits
    hits = (
        lines.join(common, "h")
        .groupBy("text_key")
        .agg(F.collect_set("h").alias("hits"))
    )
    judged = docs.select("doc_id", text.alias("text"), digest(text).alias("text_key")).join(hits, "text_key", "left")
    every = split_lines(F.col("text"))
    kept = F.when(F.col("hits").isNull(), every).otherwise(
        F.filter(every, lambda line: ~F.array_contains("hits", digest(line_key(line))))
    )
    return judged.select("doc_id", every.alias("every"), kept.alias("kept")).select(
        "doc_id",
        F.size("every").cast("bigint").alias("n_lines"),
        (F.size("every") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )

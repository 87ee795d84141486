"""Data-quality checks: cleanliness, missing values, gates and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reasons the validator writes.
REASONS = (
    "Contains uppercase",
    "Contains punctuation/special chars/apostrophes",
    "Leading/Trailing whitespace",
    "Contains double spaces",
)


def cleanliness_reasons(text: Column) -> Column:
    """Q1: reasons a text fails. "Not lower case" also covers a text without any cased letter; marks and
    blanks are only looked at when the text has no digit."""
    no_digit = ~text.rlike(r"\p{Nd}")
    lower = text.rlike(r"\p{Ll}") & ~text.rlike(r"[\p{Lu}\p{Lt}]")
    edge = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    return F.array_compact(F.array(
        F.when((text != "") & ~lower, REASONS[0]),
        F.when(no_digit & text.rlike(r"[^a-z \p{L}\p{N}_\s]"), REASONS[1]),  # the common characters are tried first
        F.when(no_digit & (F.left(text, F.lit(1)).rlike(edge) | F.right(text, F.lit(1)).rlike(edge)), REASONS[2]),
        F.when(no_digit & text.rlike(r"\s{2,}"), REASONS[3]),
    ))


def cleaning_errors(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Q1: one row per failing (row, column), NULL texts skipped.

    The reasons are told before the texts become rows, as a filter on them would tell them a second time.
    """
    cells = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).alias("original_text"),
        F.array_join(cleanliness_reasons(F.col(c)), "; ").alias("reason")) for c in columns])
    failing = F.filter(cells, lambda x: x["original_text"].isNotNull() & (x["reason"] != ""))
    return df.select(key, F.explode(failing).alias("x")).select(key, "x.*")


def cleaning_verdict(errors: DataFrame) -> DataFrame:
    """Q1: a single row: failures found and whether the table passed."""
    return errors.agg(F.count("*").alias("failures"), (F.count("*") == 0).alias("passed"))


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q2: NULL count per column from one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def row_count_gate(left: DataFrame, right: DataFrame) -> DataFrame:
    """Q3: row counts of two tables and whether they agree."""
    sizes = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return sizes.agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows")).withColumn(
        "equal", F.col("left_rows") == F.col("right_rows")
    )


def assert_same_count(left: DataFrame, right: DataFrame) -> None:
    """Q3: raise when the counts differ."""
    row = row_count_gate(left, right).first()
    if not row["equal"]:
        raise ValueError(f"row counts differ: {row['left_rows']} and {row['right_rows']}")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Q5: keys held by more than one row; empty keys are dropped first."""
    return df.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str) -> None:
    """Q5: raise when a key repeats."""
    if repeated_keys(df, key).limit(1).count():
        raise ValueError(f"duplicate values of {key}")


def guarded(df: DataFrame, ok: Column, values: dict[str, Column], error: str = "insufficient") -> DataFrame:
    """Q6: values only where the guard holds, an error text elsewhere."""
    return df.select(
        *[c for c in df.columns if c not in values],
        *[F.when(ok, v).alias(k) for k, v in values.items()],
        F.when(~ok, error).alias("error"),
    )


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q7: rows with a value in every one of the columns (NaN counts as missing)."""
    return df.na.drop(subset=list(columns))


def sane_ids(df: DataFrame, key: str, longest: int) -> DataFrame:
    """Rows whose id is present and not longer than allowed."""
    return df.where(F.col(key).isNotNull() & F.length(key).between(1, longest))

"""Joins of many rows to one row per key when a few keys hold most of the rows.

A key is hot when it holds more than a quarter of an even partition's rows. There are at most four times as many such keys
as partitions, whatever the data, so their table may be broadcast. The rows of a hot key are spread by a hash of all
their columns over as many places as it fills, and its one row is copied to each place; all other rows go where
an ordinary join sends them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS_OF_A_SHARE = 4  # a hot key holds more rows than one of so many parts of an even partition


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(many: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """The hot keys and ``_places``, how many places each is spread over; at most ``PARTS_OF_A_SHARE`` * parts rows."""
    share = PARTS_OF_A_SHARE * (parts or partitions(many))
    counts = many.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = many.agg(F.count("*")).scalar()
    return counts.where(F.col("_n") * share > total).select(*keys, F.ceil(F.col("_n") * share / total).cast("int").alias("_places"))


def join_hot(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner", salt: Column | None = None,
             parts: int | None = None) -> DataFrame:
    """``many`` joined to ``one`` on ``keys`` (inner, left, left_semi or left_anti). ``one`` should have a row or a few
    per key. ``salt`` tells rows of a key apart; by default all columns do, so only rows that are equal in all of them
    stay together. Keys that are NULL match nothing, as in any join. ``many`` is read twice: write what is dear first."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of the other side are copied, so a {how} join is not offered")
    keys = list(keys)
    hot = F.broadcast(hot_keys(many, keys, parts))
    places = F.coalesce(F.col("_places"), F.lit(1))
    salted = many.withColumn("_salt", F.xxhash64(*many.columns) if salt is None else F.xxhash64(salt)).join(
        hot, keys, "left").withColumn("_salt", F.pmod("_salt", places).cast("int")).drop("_places")
    copied = one.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), places - 1))).drop("_places")
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")

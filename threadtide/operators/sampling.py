"""Reproducible samples, splits and de-duplication, ordered by the md5 of an id and a seed.

Per-class picks never put one class into one task: each class is cut into salted shards by the hash,
the shards hand on their own smallest n, and only those survivors meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 64


def hash_key(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows without replacement (n is the size of a sample, a top-n over the hash)."""
    return df.orderBy(hash_key(key, seed), key).limit(n)


def fraction(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Keep a row when the leading 7 hex digits of its hash fall below the share."""
    lead = F.conv(F.substring(hash_key(key, seed), 1, 7), 16, 10).cast("bigint")
    return df.where(lead < F.lit(int(share * 16**7)))


def first_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, salt: Column) -> DataFrame:
    """The first n rows of each group; a group is first reduced inside its shards."""
    rows = df.withColumn("_shard", F.pmod(F.xxhash64(salt), F.lit(SHARDS)))
    local = Window.partitionBy(*by, "_shard").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        rows.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n)
        .drop("_r", "_shard")
    )


def balanced_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows per class."""
    return first_n_per_group(df, [label], [hash_key(key, seed), F.col(key)], n, F.col(key))


def per_user_sample(df: DataFrame, user: str, key: str, n: int = 20, seed: int = 42) -> DataFrame:
    """At most n random rows per user."""
    return first_n_per_group(df, [user], [hash_key(key, seed), F.col(key)], n, F.col(key))


def stratified_split(df: DataFrame, label: str, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Parts of the given shares within every class, as a column ``part``.

    The place of a row inside its class comes from ordered counts over the leading 48 bits of its
    hash, so a class is never one task.
    """
    from threadtide.operators.ranks import ordered_counts

    place = F.conv(F.substring(hash_key(key, seed), 1, 12), 16, 10).cast("bigint")
    rows = df.withColumn("_h", place.cast("double"))
    ranks = ordered_counts(rows, "_h", [label]).select(
        label, "_h", (F.col("n_before") / F.col("n_total")).alias("_q")
    )
    part, edge = None, 0.0
    items = list(shares.items())
    for name, share in items[:-1]:
        edge += share
        test = F.col("_q") < F.lit(round(edge, 9))
        part = F.when(test, name) if part is None else part.when(test, name)
    last = F.lit(items[-1][0])
    return rows.join(ranks, [label, "_h"]).withColumn("part", part.otherwise(last) if part is not None else last).drop(
        "_h", "_q"
    )


def keep_first(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order``; an aggregation, so copies fold map-side."""
    rest = [c for c in df.columns if c not in by and c != order]
    best = F.min_by(F.struct(*rest), F.col(order)) if rest else None
    out = df.groupBy(*by).agg(F.min(order).alias(order), *([best.alias("_row")] if rest else []))
    return out.select(*by, order, *[F.col("_row")[c].alias(c) for c in rest])

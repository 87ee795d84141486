"""Keyed joins that replace positional alignment, and the root-to-replies join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtide.operators.skew import join_hot


def with_leaning(comments: DataFrame, posts: DataFrame, leaning: DataFrame) -> DataFrame:
    """Comments of posts whose author has a known leaning. Post numbers restart per author, so the
    join uses both keys. The planner broadcasts the dimension when its size allows."""
    sided = posts.join(leaning, "author_id").select("author_id", "post_id", "leaning")
    return comments.join(sided, ["author_id", "post_id"])


def concat_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Side-by-side columns of two tables that share a key."""
    return left.join(right, key)


def merge_with_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Inner join in which clashing columns of the right side take the suffix."""
    clash = set(left.columns) & set(right.columns) - {key}
    renamed = right.select(*[F.col(c).alias(c + suffix if c in clash else c) for c in right.columns])
    return left.join(renamed, key)


def bring_columns(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of another table, NULL where the key is missing there."""
    return left.join(right.select(key, *columns), key, "left")


def roots_with_replies(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Root comments with aggregates of their direct replies, folded by parent before the join."""
    replies = (
        df.where(F.col("parent_id").isNotNull())
        .groupBy(F.col("parent_id").alias("comment_id"))
        .agg(F.count("*").alias("n_replies"), *[c.alias(k) for k, c in aggregates.items()])
    )
    return df.where(F.col("parent_id").isNull()).join(replies, "comment_id")


def looked_up(df: DataFrame, key: str, mapping: DataFrame, map_key: str, map_value: str, name: str) -> DataFrame:
    """Value of a mapping table, or the key itself where the table has none. A key that many rows share is looked
    up in several places."""
    pairs = mapping.select(F.col(map_key).alias("_k"), F.col(map_value).alias("_v"))
    return join_hot(df.withColumn("_k", F.col(key)), pairs, ["_k"], "left").withColumn(
        name, F.coalesce("_v", F.col(key))
    ).drop("_k", "_v")

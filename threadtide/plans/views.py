"""Adapter views that dress the driver tables up as scored comments, threads and social posts.

Each view exists twice: as a DataFrame and as SQL text for the DuckDB twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadtide.functions import index as ix
from threadtide.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # whole texts are costly per row, and a small sample of them is a single row group
    return spread(df.select("doc_id", "text", "lang", "n_chars")) if name == "documents" else df


# ---------------------------------------------------------------- scored comments (from events)

SC = """sc AS (
  SELECT event_id + 1 AS comment_id,
         'u' || CAST(user_id AS VARCHAR) AS commenter_id,
         'a' || CAST(mod(CAST(floor(event_id / 8e0) AS BIGINT), 7) AS VARCHAR) AS author_id,
         1 + mod(CAST(floor(event_id / 8e0) AS BIGINT), 20) AS post_id,
         CASE WHEN mod(event_id, 8) = 0 THEN NULL ELSE event_id - mod(event_id, 8) + 1 END AS parent_id,
         props AS comment_content,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive'
              WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment_label,
         0.34e0 + mod(event_id * 37, 66) / 1e2 AS sentiment_prob,
         mod(event_id * 7919, 1000) / 1e3 AS hate_prob,
         mod(event_id * 104729, 1000) / 1e3 AS offensive_prob,
         mod(event_id * 15485863, 1000) / 1e3 AS irony_prob,
         value / 5e2 AS rage,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 1e2 AS ai_confidence,
         CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) >= 50 THEN 1 ELSE 0 END AS label,
         CASE WHEN mod(event_id * 7919, 1000) >= 500 THEN 'HATE' ELSE 'NOT-HATE' END AS hate_label,
         CASE WHEN mod(event_id * 104729, 1000) >= 500 THEN 'offensive' ELSE 'non-offensive' END AS offensive_label,
         CASE WHEN mod(event_id * 15485863, 1000) >= 500 THEN 'irony' ELSE 'non_irony' END AS irony_label,
         mod(event_id, 13) = 0 AS tagged_grok
  FROM events),
x AS (
  SELECT *, (rage + offensive_prob + hate_prob) * (1e0 - abs(s)) AS rbi
  FROM (SELECT *, CASE sentiment_label WHEN 'positive' THEN sentiment_prob
                       WHEN 'negative' THEN -sentiment_prob ELSE 0e0 END AS s FROM sc) t)"""


def sc_sql(body: str) -> str:
    return f"WITH {SC} {body}"


def scored_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View 1: one scored comment per event."""
    e = F.col("event_id")
    conf = F.regexp_extract("props", "([0-9]+)", 1)
    thread = F.floor(e / F.lit(8.0)).cast("bigint")
    return table(spark, sf_dir, "events").select(
        (e + 1).alias("comment_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("commenter_id"),
        F.concat(F.lit("a"), (thread % 7).cast("string")).alias("author_id"),
        (thread % 20 + 1).alias("post_id"),
        F.when(e % 8 != 0, e - e % 8 + 1).alias("parent_id"),
        F.col("props").alias("comment_content"),
        F.when(F.col("event_type").isin("purchase", "signup"), "positive")
        .when(F.col("event_type") == "error", "negative")
        .otherwise("neutral")
        .alias("sentiment_label"),
        (F.lit(0.34) + (e * 37 % 66) / F.lit(100.0)).alias("sentiment_prob"),
        ((e * 7919 % 1000) / F.lit(1000.0)).alias("hate_prob"),
        ((e * 104729 % 1000) / F.lit(1000.0)).alias("offensive_prob"),
        ((e * 15485863 % 1000) / F.lit(1000.0)).alias("irony_prob"),
        (F.col("value") / F.lit(500.0)).alias("rage"),
        (conf.cast("double") / F.lit(100.0)).alias("ai_confidence"),
        F.when(conf.cast("bigint") >= 50, 1).otherwise(0).alias("label"),
        F.when(e * 7919 % 1000 >= 500, "HATE").otherwise("NOT-HATE").alias("hate_label"),
        F.when(e * 104729 % 1000 >= 500, "offensive").otherwise("non-offensive").alias("offensive_label"),
        F.when(e * 15485863 % 1000 >= 500, "irony").otherwise("non_irony").alias("irony_label"),
        (e % 13 == 0).alias("tagged_grok"),
    )


def indexed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored comments with the signed sentiment ``s`` and the rage-bait index ``rbi``."""
    return ix.with_index(scored_comments(spark, sf_dir), rage="rage")


# author -> leaning: the author number mod 3 (View 1's leaning dimension)
LEANING = """leaning AS (
  SELECT DISTINCT author_id, CASE mod(CAST(substr(author_id, 2) AS BIGINT), 3)
         WHEN 0 THEN 'Left' WHEN 1 THEN 'Right' ELSE 'Neutral' END AS leaning FROM sc)"""


def leaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.substring("author_id", 2, 9).cast("bigint") % 3
    return (
        scored_comments(spark, sf_dir)
        .select("author_id")
        .distinct()
        .withColumn("leaning", F.when(side == 0, "Left").when(side == 1, "Right").otherwise("Neutral"))
    )


# posts of the scored comments, keyed by author and post number
POSTS = "posts AS (SELECT DISTINCT author_id, post_id FROM sc)"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_comments(spark, sf_dir).select("author_id", "post_id").distinct()


# ---------------------------------------------------------------- threads (from conversations)

TH = """th AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN turn = 0 THEN NULL ELSE CAST(floor((turn - 1) / 2e0) AS BIGINT) END AS parent_turn
  FROM conversations)"""


def th_sql(body: str) -> str:
    return f"WITH {TH} {body}"


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View 2: one post per conversation; the turns below it form a binary reply tree."""
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.when(t != 0, F.floor((t - 1) / F.lit(2.0)).cast("bigint")).alias("parent_turn"),
    )


# ---------------------------------------------------------------- social text (from documents)

ST = """st AS (
  SELECT doc_id, lang, 'acct' || CAST(mod(doc_id, 5) AS VARCHAR) AS author,
         CASE mod(doc_id, 6)
           WHEN 0 THEN 'RT @acct1: ' || b
           WHEN 1 THEN '@grok OMG this is CRAZY :) ' || b
           WHEN 2 THEN b || ' https://t.co/a' || CAST(doc_id AS VARCHAR) || ', 😂😂'
           WHEN 3 THEN b || ' #BreakingNews #Covid19 1,000 7k 1st 2024'
           WHEN 4 THEN b || ' https://x.com/s/status/' || CAST(doc_id AS VARCHAR)
                         || '/photo/1 soooo gr8 f0ll0w abc123 @acct2'
           ELSE b END AS content
  FROM (SELECT *, replace(text, chr(10), ' ') AS b FROM documents) d)"""


def st_sql(body: str) -> str:
    return f"WITH {ST} {body}"


def social_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View 3: whole documents decorated as posts with mentions, links, hashtags and numbers."""
    b = F.translate("text", "\n", " ")
    d = F.col("doc_id").cast("string")
    rest = F.col("doc_id") % 6
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.lit("acct"), (F.col("doc_id") % 5).cast("string")).alias("author"),
        F.when(rest == 0, F.concat(F.lit("RT @acct1: "), b))
        .when(rest == 1, F.concat(F.lit("@grok OMG this is CRAZY :) "), b))
        .when(rest == 2, F.concat(b, F.lit(" https://t.co/a"), d, F.lit(", 😂😂")))
        .when(rest == 3, F.concat(b, F.lit(" #BreakingNews #Covid19 1,000 7k 1st 2024")))
        .when(rest == 4, F.concat(b, F.lit(" https://x.com/s/status/"), d,
                                  F.lit("/photo/1 soooo gr8 f0ll0w abc123 @acct2")))
        .otherwise(b)
        .alias("content"),
    )

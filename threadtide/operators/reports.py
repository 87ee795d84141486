"""Dashboard aggregates, distributions, histograms and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtide.functions import index as ix
from threadtide.operators.ranks import ordered_counts, quantiles_of


def dashboard_totals(df: DataFrame) -> DataFrame:
    """Headline counts, sentiment split and shares over rows whose user id is sane."""
    user = F.col("commenter_id")
    rows = df.where(user.isNotNull() & (F.length(user) > 0) & (F.length(user) <= 50))
    n = F.count("*")
    sentiment = F.col("sentiment_label")
    positive, negative = F.count_if(sentiment == "positive"), F.count_if(sentiment == "negative")
    hate, offensive = F.count_if(F.col("hate_label") == "HATE"), F.count_if(F.col("offensive_label") == "offensive")
    return rows.agg(
        n.alias("total_comments"),
        F.countDistinct(user).alias("unique_users"),
        hate.alias("hate_comments"),
        offensive.alias("offensive_comments"),
        F.count_if(F.col("tagged_grok") | (user == "grok")).alias("assistant_comments"),
        positive.alias("positive"),
        negative.alias("negative"),
        (n - positive - negative).alias("neutral"),
        (positive / n * 100).alias("pct_positive"),
        (negative / n * 100).alias("pct_negative"),
        ((n - positive - negative) / n * 100).alias("pct_neutral"),
        (hate / n * 100).alias("pct_hate"),
        (offensive / n * 100).alias("pct_offensive"),
    )


def dashboard_users(df: DataFrame) -> DataFrame:
    """Counts, mean probabilities, toxicity and status per user."""
    user = F.col("commenter_id")
    hate, offensive = F.count_if(F.col("hate_label") == "HATE"), F.count_if(F.col("offensive_label") == "offensive")
    return (
        df.where(user.isNotNull() & (F.length(user) > 0) & (F.length(user) <= 30))
        .groupBy("commenter_id")
        .agg(
            F.count("*").alias("comments"),
            hate.alias("hate_count"),
            offensive.alias("offensive_count"),
            F.count_if(F.col("sentiment_label") == "negative").alias("negative_count"),
            F.count_if("tagged_grok").alias("grok_tags"),
            (F.sum(F.coalesce("hate_prob", F.lit(0.0))) / F.count("*")).alias("avg_hate"),
            (F.sum(F.coalesce("offensive_prob", F.lit(0.0))) / F.count("*")).alias("avg_offensive"),
            ((hate + offensive) / F.count("*")).alias("toxicity"),
        )
        .withColumn("status", ix.user_status(F.col("hate_count"), F.col("toxicity")))
    )


def search_users(users: DataFrame, text: str, sort_by: str, limit: int = 100) -> DataFrame:
    """Case-insensitive substring search over the user table, best 100 by the chosen key."""
    keys = {"count": "comments", "hate": "avg_hate", "offensive": "avg_offensive"}
    found = users.where(F.lower("commenter_id").contains(text.lower()))
    return found.orderBy(F.desc(F.round(keys[sort_by], 9)), "commenter_id").limit(limit)


def top_users(df: DataFrame, k: int = 20, longest: int = 29) -> DataFrame:
    """The k users with most comments among ids of at most ``longest`` characters."""
    return (
        df.where(F.length("commenter_id").between(1, longest))
        .groupBy("commenter_id")
        .agg(F.count("*").alias("comments"))
        .orderBy(F.desc("comments"), "commenter_id")
        .limit(k)
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of the values of a column."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") / total * 100)


def cross_tab(df: DataFrame, row: str, column: str, levels: Sequence) -> DataFrame:
    """Zero-filled cross-tab with row-normalised proportions."""
    names = [f"{column}_{lv}" for lv in levels]
    hits = [F.count_if(F.col(column) == lv).alias(nm) for lv, nm in zip(levels, names)]
    total = sum((F.col(nm) for nm in names), F.lit(0))
    return df.groupBy(row).agg(*hits).select(
        row, *names, *[F.when(total > 0, F.col(nm) / total).alias(f"share_{nm}") for nm in names]
    )


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of several columns at once."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns
    ]))
    long = df.select(cells.alias("x")).select("x.*")
    counts = ordered_counts(long, "v", ["column"])
    moments = long.where(F.col("v").isNotNull()).groupBy("column").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    quarts = quantiles_of(counts, "v", [0.25, 0.5, 0.75], ["column"], ["p25", "p50", "p75"])
    return quarts.join(moments, "column")


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """Count and density per equal-width bin over [low, high], the last bin closed."""
    v = F.col(value)
    slot = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("bigint")
    counts = df.where((v >= low) & (v <= high)).groupBy(*by, slot.alias("bin")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by, F.lit(0))  # at most ``bins`` rows per group
    return counts.withColumn(
        "density", F.col("n") / F.sum("n").over(whole) / F.lit((high - low) / bins)
    )


def box_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Extremes and exact quartiles per group."""
    return quantiles_of(
        ordered_counts(df, value, [by]), value, [0, 0.25, 0.5, 0.75, 1], [by], ["low", "q1", "median", "q3", "high"]
    )


def error_by_bin(df: DataFrame, target: str, predicted: str, bins: int = 10) -> DataFrame:
    """Mean absolute error per equal bin of the target; the upper end 1.0 is left out."""
    t = F.col(target)
    return (
        df.where((t >= 0) & (t < 1))
        .groupBy(F.floor(t * bins).cast("bigint").alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(F.abs(t - F.col(predicted))).alias("mae"))
    )


def count_bins(df: DataFrame, user: str = "commenter_id") -> DataFrame:
    """Users per bin of their comment count, every bin present."""
    counts = df.groupBy(user).agg(F.count("*").alias("c"))
    found = counts.groupBy(ix.count_bin(F.col("c")).alias("bin")).agg(F.count("*").alias("u"))
    bins = df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(ix.COUNT_BINS)], "bin_order bigint, bin string")
    return bins.join(found, "bin", "left").select(
        "bin_order", "bin", F.coalesce("u", F.lit(0)).cast("bigint").alias("num_users")
    )


def dataset_block(df: DataFrame) -> DataFrame:
    """The dataset summary of a report."""
    n = F.count("*")
    bots, humans = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.agg(
        n.alias("comments"),
        bots.alias("bots"),
        humans.alias("humans"),
        (bots / n * 100).alias("pct_bots"),
        (humans / n * 100).alias("pct_humans"),
        F.avg("ai_confidence").alias("mean_confidence"),
        F.avg("rbi").alias("mean_rbi"),
        F.stddev_samp("rbi").alias("std_rbi"),
    )


def kept_share(df: DataFrame, keep: Column) -> DataFrame:
    """Size before and after a filter and the percentage kept."""
    return df.agg(
        F.count("*").alias("original"),
        F.count_if(keep).alias("kept"),
        (F.count_if(keep) / F.count("*") * 100).alias("pct_kept"),
    )


def agreement(df: DataFrame, a: str, b: str, conf: str, at_least: float = 0.8) -> DataFrame:
    """Agreement of two label columns and the size of the confirmed subset."""
    same = F.col(a) == F.col(b)
    return df.agg(
        F.count("*").alias("rows"),
        F.avg(same.cast("int")).alias("agreement"),
        F.count_if(same & (F.col(conf) >= at_least)).alias("confirmed"),
        F.count_if(same & (F.col(conf) >= at_least) & (F.col(a) == 1)).alias("confirmed_positive"),
    )

"""Per-user roll-ups, votes, profiles, top-user enrichment and the training grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtide.functions import index as ix
from threadtide.operators.ranks import global_row_number


def user_means(df: DataFrame, features: Sequence[str], user: str = "commenter_id",
               by: Sequence[str] = ()) -> DataFrame:
    """A1/A5: mean of every feature per user (booleans as 0/1) and the comment count."""
    flags = {f.name for f in df.schema.fields if f.dataType.typeName() == "boolean"}
    aggs = [F.avg(F.col(f).cast("int") if f in flags else F.col(f)).alias(f"avg_{f}") for f in features]
    return df.groupBy(*by, user).agg(*aggs, F.count("*").alias("num_comments"))


def vector_moments(df: DataFrame, key: str, vector: str) -> DataFrame:
    """A2: element-wise mean and population deviation of the vectors of each key, as (key, pos) rows."""
    return (
        df.select(key, F.posexplode(vector).alias("pos", "val"))
        .groupBy(key, "pos")
        .agg(F.avg("val").alias("mean"), F.stddev_pop("val").alias("std"))
    )


def vector_profile(df: DataFrame, key: str, vector: str) -> DataFrame:
    """A2: the moments put back together as one mean and one deviation vector per key."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))  # as long as the vector
    return (
        vector_moments(df, key, vector)
        .groupBy(key)
        .agg(cells.alias("c"))
        .select(
            key,
            F.transform("c", lambda x: x["mean"]).alias(f"{vector}_mean"),
            F.transform("c", lambda x: x["std"]).alias(f"{vector}_std"),
        )
    )


def vector_reduced(df: DataFrame, key: str, vector: str) -> DataFrame:
    """A3: mean of the mean vector and of the deviation vector."""
    return vector_moments(df, key, vector).groupBy(key).agg(
        F.avg("mean").alias(f"{vector}_mean_reduced"), F.avg("std").alias(f"{vector}_std_reduced")
    )


def weighted_votes(df: DataFrame, pairs: Sequence[tuple[str, str]], user: str = "commenter_id",
                   by: Sequence[str] = ()) -> DataFrame:
    """A4: per user and label column, the label with the largest total probability; ties go to the
    smallest label. All columns share one shuffle; a label set per user is small, so the second
    aggregation reads only (user, column, label) totals."""
    votes = F.explode(F.array(*[
        F.struct(F.lit(lab).alias("col"), F.col(lab).cast("string").alias("label"), F.col(prob).alias("p"))
        for lab, prob in pairs
    ]))
    totals = (
        df.select(*by, user, votes.alias("v"))
        .where(F.col("v.label").isNotNull())
        .groupBy(*by, user, F.col("v.col").alias("col"), F.col("v.label").alias("label"))
        .agg(F.sum("v.p").alias("w"))
    )
    # Sums of probabilities depend on the order of addition in their last bits: ties are decided on 9 digits.
    best = F.struct((-F.round("w", 9)).alias("w"), F.col("label"))
    return totals.groupBy(*by, user).agg(*[
        F.min(F.when(F.col("col") == lab, best))["label"].alias(f"{lab}_weighted") for lab, _ in pairs
    ])


def user_stats(df: DataFrame) -> DataFrame:
    """Mean index, label and confidence and the comment count of each user, NULL labels left out."""
    return (
        df.where(F.col("label").isNotNull())
        .groupBy("commenter_id")
        .agg(
            F.avg("rbi").alias("rbi"),
            F.avg("label").alias("label"),
            F.avg("ai_confidence").alias("ai_confidence"),
            F.count("comment_id").alias("n_comments"),
        )
    )


def user_profiles(df: DataFrame) -> DataFrame:
    """Index moments, emotional means, probability of being a bot and the first comment."""
    return df.groupBy("commenter_id").agg(
        F.avg("rbi").alias("avg_rbi"),
        F.stddev_samp("rbi").alias("std_rbi"),
        F.max("rbi").alias("max_rbi"),
        F.count("rbi").alias("comment_count"),
        F.avg("label").alias("bot_probability"),
        F.avg("ai_confidence").alias("avg_confidence"),
        F.avg("s").alias("avg_sentiment"),
        F.avg("offensive_prob").alias("avg_offensive"),
        F.avg("hate_prob").alias("avg_hate"),
        F.avg("rage").alias("avg_rage"),
        F.min_by("comment_content", "comment_id").alias("sample_comment"),
    )


def ranked_users(stats: DataFrame) -> DataFrame:
    """Users numbered by falling mean index, ties by id, with the number of users."""
    key = F.round("rbi", 9)  # equal means must tie whatever the order of addition
    return global_row_number(stats, [key.desc(), F.col("commenter_id").asc()], "place")


def top_size(n_users: Column, share: Column, least: int) -> Column:
    return F.greatest(F.floor(n_users * share).cast("bigint"), F.lit(least).cast("bigint"))


def enrichment(df: DataFrame, percentiles: Sequence[float] = (0.1, 1, 5, 10, 25, 50)) -> DataFrame:
    """Share of machine users in the top percentiles of the index, over the baseline.

    Users are ranked once; every user is repeated for the percentiles that contain it, and one
    aggregation serves them all.
    """
    baseline = df.agg((F.avg("label") * 100).alias("b"))
    ranked = ranked_users(user_stats(df))
    grid = F.array(*[F.lit(float(p)) for p in percentiles])
    size = lambda p: top_size(F.col("place_total"), p / F.lit(100.0), 1)
    held = F.explode(F.filter(grid, lambda p: F.col("place") <= size(p)))
    sums = (
        ranked.withColumn("percentile", held)
        .groupBy("percentile")
        .agg(
            F.count("*").alias("n_users"),
            F.avg("rbi").alias("mean_rbi"),
            F.sum("ai_confidence").alias("conf"),
            F.count_if(F.col("label") >= 0.5).alias("hard"),
        )
    )
    b = baseline.scalar()
    soft = F.col("conf") / F.col("n_users") * 100
    hard = F.col("hard") / F.col("n_users") * 100
    return sums.select(
        "percentile",
        "n_users",
        "mean_rbi",
        soft.alias("prob_bot_pct"),
        F.when(b > 0, soft / b).alias("prob_enrichment"),
        hard.alias("hard_bot_pct"),
        F.when(b > 0, hard / b).alias("hard_enrichment"),
        b.alias("baseline_pct"),
    )


def super_spreaders(df: DataFrame, share: float = 0.01, least: int = 10) -> DataFrame:
    """The top share of users by mean index, counted three ways, against the baseline.

    As in the reference, the percentages divide by the wanted size even when fewer users exist.
    """
    ranked = ranked_users(user_stats(df))
    n_top = top_size(F.col("place_total"), F.lit(share), least)
    sums = (
        ranked.withColumn("n_top_users", n_top)
        .where(F.col("place") <= F.col("n_top_users"))
        .groupBy("n_top_users")
        .agg(
            F.sum("ai_confidence").alias("prob_bot_count"),
            F.sum("label").alias("label_count"),
            F.sum(F.col("label") * F.col("ai_confidence")).alias("weighted_count"),
            F.count_if(F.col("label") >= 0.5).alias("hard_bot_count"),
        )
    )
    b = df.agg((F.avg("label") * 100).alias("b")).scalar()
    n = F.col("n_top_users")
    pct = F.col("prob_bot_count") / n * 100
    return sums.select(
        "n_top_users",
        "prob_bot_count",
        pct.alias("pct_synthetic"),
        (F.col("label_count") / n * 100).alias("pct_label"),
        (F.col("weighted_count") / n * 100).alias("pct_weighted"),
        "hard_bot_count",
        (F.col("hard_bot_count") / n * 100).alias("hard_pct"),
        b.alias("baseline_pct"),
        F.when(b > 0, pct / b).alias("enrichment"),
    )


def label_shares(df: DataFrame, user: str, label: str, positive, more_than: int = 2) -> DataFrame:
    """A10: share of the positive label for users with more than ``more_than`` comments."""
    return (
        df.where(F.col(user).isNotNull() & F.col(label).isNotNull())
        .groupBy(user)
        .agg(F.count("*").alias("comment_count"), F.avg((F.col(label) == positive).cast("int")).alias("share_positive"))
        .where(F.col("comment_count") > more_than)
    )


def pair_agreement(df: DataFrame, user: str, label: str, conf: str, size: int = 2) -> DataFrame:
    """Users with exactly ``size`` comments: how many agree with themselves, plain and by confidence."""
    pairs = (
        df.where(F.col(user).isNotNull() & F.col(label).isNotNull())
        .groupBy(user)
        .agg(
            F.count("*").alias("n"),
            (F.min(label) == F.max(label)).alias("agrees"),
            F.sum(conf).alias("total_conf"),
        )
        .where(F.col("n") == size)
    )
    yes = F.col("agrees")
    return pairs.agg(
        F.count("*").alias("users"),
        F.count_if(yes).alias("agreement"),
        F.count_if(~yes).alias("disagreement"),
        F.coalesce(F.sum(F.when(yes, F.col("total_conf"))), F.lit(0.0)).alias("agree_weight"),
        F.coalesce(F.sum(F.when(~yes, F.col("total_conf"))), F.lit(0.0)).alias("disagree_weight"),
    )


def weighted_label_shares(df: DataFrame, user: str, label: str, positive, conf: str, more_than: int = 2) -> DataFrame:
    """Confidence-weighted share of the positive label; a zero total counts as one."""
    total = F.sum(conf)
    hits = F.sum(F.when(F.col(label) == positive, F.col(conf)).otherwise(F.lit(0.0)))
    return (
        df.na.drop(subset=[user, label, conf])
        .groupBy(user)
        .agg(
            F.count("*").alias("comment_count"),
            (hits / F.when(total > 0, total).otherwise(F.lit(1.0))).alias("share_positive"),
        )
        .where(F.col("comment_count") > more_than)
    )


def leaning_groups(df: DataFrame, value: str, leaning: str = "leaning", label: str = "label") -> DataFrame:
    """Mean, size and sample deviation per leaning and label."""
    return df.groupBy(leaning, label).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_samp(value).alias("std")
    )


def bot_effect(df: DataFrame, value: str, leaning: str = "leaning", label: str = "label") -> DataFrame:
    """Bot minus human mean on either side and the difference of the two, in one row."""
    def mean(side: str, k: int) -> Column:
        return F.avg(F.when((F.col(leaning) == side) & (F.col(label) == k), F.col(value)))

    return df.agg(
        (mean("Left", 1) - mean("Left", 0)).alias("effect_left"),
        (mean("Right", 1) - mean("Right", 0)).alias("effect_right"),
    ).withColumn("differential", F.col("effect_right") - F.col("effect_left"))


def deciles(stats: DataFrame, value: str, prob: str, bins: int = 10) -> DataFrame:
    """Bot probability and index per quantile bin of the users."""
    from threadtide.operators.ranks import quantile_cut

    return quantile_cut(stats, value, bins, "decile").groupBy("decile").agg(
        F.avg(prob).alias("bot_prob_mean"),
        F.stddev_samp(prob).alias("bot_prob_std"),
        F.avg(value).alias("avg_rbi"),
        F.count("*").alias("user_count"),
    )


def grid_rows(df: DataFrame, thresholds: Sequence[float], conf: str = "ai_confidence") -> DataFrame:
    """Rows repeated once per confidence threshold whose two-sided filter they pass."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    c = F.col(conf)
    return df.withColumn(
        "threshold", F.explode(F.filter(grid, lambda t: (c <= t) | (c >= F.lit(1.0) - t)))
    )


def grid_user_labels(
    df: DataFrame, min_comments: Sequence[int], thresholds: Sequence[float]
) -> DataFrame:
    """One row per grid cell and surviving user, with its comment count and voted label.

    The data is read once: rows are expanded by the thresholds they pass, folded to users, and only
    then matched with the minimum counts.
    """
    rows = grid_rows(df, thresholds)
    votes = weighted_votes(rows, [("label", "ai_confidence")], by=["threshold"])
    sizes = rows.groupBy("threshold", "commenter_id").agg(F.count("*").alias("num_comments"))
    grid = F.array(*[F.lit(int(m)) for m in min_comments])
    kept = F.explode(F.filter(grid, lambda m: F.col("num_comments") >= m))
    return sizes.join(votes, ["threshold", "commenter_id"]).withColumn("min_comments", kept)


def grid_summary(df: DataFrame, min_comments: Sequence[int], thresholds: Sequence[float]) -> DataFrame:
    """Rows and users left and class shares for every cell of the grid."""
    one = F.col("label_weighted") == "1"
    return grid_user_labels(df, min_comments, thresholds).groupBy("min_comments", "threshold").agg(
        F.sum("num_comments").alias("rows_kept"),
        F.count("*").alias("users"),
        F.count_if(one).alias("users_bot"),
        (F.count_if(one) / F.count("*") * 100).alias("pct_bot"),
    )


def active_users(df: DataFrame, at_least: int, user: str = "commenter_id") -> DataFrame:
    """Rows of users with at least that many rows. Users are counted first and joined back, so a
    very busy user is spread over tasks instead of being one window partition."""
    busy = df.groupBy(user).agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least).select(user)
    return df.join(busy, user, "left_semi")


def rows_of_top_users(df: DataFrame, k: int, user: str = "commenter_id") -> DataFrame:
    """Rows of the k busiest users (k is a small report size)."""
    top = df.groupBy(user).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), user).limit(k).select(user)
    return df.join(F.broadcast(top), user, "left_semi")


def user_table(df: DataFrame, features: Sequence[str], pairs: Sequence[tuple[str, str]],
               vector: str | None = None) -> DataFrame:
    """The user feature table: means, counts, voted labels and, when given, reduced vector moments."""
    out = user_means(df, features).join(weighted_votes(df, pairs), "commenter_id")
    if vector is not None:
        out = out.join(vector_reduced(df, "commenter_id", vector), "commenter_id", "left")
    return out

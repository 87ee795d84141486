"""Flattening of reply trees and tree counts."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadtide.functions import text as tx
from threadtide.operators.ranks import global_row_number
from threadtide.operators.skew import join_hot
from threadtide.session import cut_lineage, fresh_path
from threadtide.sources.schemas import COUNTERS, JSON_DEPTH

LEVELS = 3  # of replies that one pass unfolds; the analyser takes long over lambdas that are nested deeper


def _replies(posts: DataFrame) -> Column:
    """The replies as JSON text; typed arrays are turned into text."""
    if "replies_content" not in posts.columns:
        return F.lit(None).cast("string")
    held = F.col("replies_content")
    return held if posts.schema["replies_content"].dataType == T.StringType() else F.to_json(held)


def _row(text: dict[str, Column], numbers: dict[str, Column], parent_id: Column, parent_user: Column, path: Column,
         below: Column) -> Column:
    blank = {k: F.coalesce(c, F.lit("")) for k, c in text.items()}
    return F.struct(
        blank["link"].alias("id"), blank["username"].alias("username"), blank["content"].alias("content"), parent_id.alias("parent_id"),
        *[F.coalesce(numbers[c], F.lit(0).cast("bigint")).alias(c) for c in COUNTERS],
        path.alias("path"), parent_user.alias("parent_username"), below.alias("_below"))


def _below(replies: Column, parent_id: Column, parent_user: Column, path: Column, levels: int) -> Column:
    """The rows of ``levels`` levels of replies, given as a VARIANT. The deepest keep what is below them."""
    def rows(x: Column) -> Column:
        n, here = x["n"], F.concat(path, F.array(x["i"]))
        text = {k: F.try_variant_get(n, f"$.{k}", "string") for k in ("link", "username", "content")}
        numbers = {k: F.try_variant_get(n, f"$.{k}", "bigint") for k in COUNTERS}
        own = F.try_variant_get(n, "$.replies_content", "variant")
        if levels == 1:
            return F.array(_row(text, numbers, parent_id, parent_user, here, own))
        one = F.array(_row(text, numbers, parent_id, parent_user, here, F.lit(None).cast("variant")))
        link, user = F.coalesce(text["link"], F.lit("")), F.coalesce(text["username"], F.lit(""))
        return F.concat(one, _below(own, link, user, here, levels - 1))

    nodes = F.coalesce(F.try_variant_get(replies, "$", "array<variant>"), F.array().cast("array<variant>"))
    placed = F.transform(nodes, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    return F.flatten(F.transform(F.filter(placed, lambda x: ~F.is_variant_null(x["n"])), rows))


def flatten_threads(posts: DataFrame) -> DataFrame:
    """One row per post, comment and reply with its parent's id and the author of the file.

    Replies are parsed once, into a VARIANT, and unfold ``LEVELS`` levels in a pass without shuffles; each pass is a written
    stage, and only replies nested deeper wait for the next one. ``path`` holds the sibling positions below the post and
    gives the pre-order.
    """
    keep = [c for c in ("author_id", "post_id") if c in posts.columns]
    nothing, root = F.lit(""), F.array().cast("array<int>")
    text = {k: F.col(k) for k in ("link", "username", "content")}
    numbers = {k: F.col(k).cast("bigint") for k in COUNTERS}
    link, user = (F.coalesce(text[k], nothing) for k in ("link", "username"))
    held = posts.withColumn("_held", F.parse_json(_replies(posts)))
    top = F.array(_row(text, numbers, nothing, nothing, root, F.lit(None).cast("variant")))
    unfolded = F.concat(top, _below(F.col("_held"), link, user, root, LEVELS))
    level = held.select(*keep, F.explode(unfolded).alias("_r")).select(*keep, "_r.*")
    path, schema = fresh_path(posts.sparkSession, "threads"), level.schema

    def written(rows: DataFrame, nth: int) -> DataFrame:
        rows.write.parquet(f"{path}/level={nth}")
        return posts.sparkSession.read.schema(schema).parquet(f"{path}/level={nth}")

    for nth in count():
        level = written(level, nth)
        waiting = level.where(F.try_variant_get("_below", "$[0]", "variant").isNotNull())
        if waiting.isEmpty():
            return posts.sparkSession.read.schema(schema).parquet(path).drop("level", "_below")
        more = _below(F.col("_below"), F.col("id"), F.col("username"), F.col("path"), LEVELS)
        level = waiting.select(*keep, F.explode(more).alias("_r")).select(*keep, "_r.*")


def numbered_posts(posts: DataFrame, order: str) -> DataFrame:
    """Post numbers 1, 2, ... restarting per author, in the order of a key of any orderable type.

    Posts are numbered once over all authors by (author, key); an author's first number is taken off, so that a very
    busy author is no window partition.
    """
    rows = global_row_number(posts, [F.col("author_id"), F.col(order)], "_place").drop("_place_total")
    first = rows.groupBy("author_id").agg(F.min("_place").alias("_first"))
    return join_hot(rows, first, ["author_id"]).withColumn("post_id", F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def comments_table(posts: DataFrame) -> DataFrame:
    """All comments of numbered posts with a global pre-order id, the parent's id and the features.

    Ids come from one range shuffle on (author, post, path); the parent is found by its path.
    """
    flat = flatten_threads(posts.withColumn("_post_author", F.col("username")))
    authors = posts.select("author_id", "post_id", F.col("username").alias("post_author"))
    comments = flat.where(F.size("path") > 0).join(authors, ["author_id", "post_id"])
    order = [F.col("author_id"), F.col("post_id"), F.col("path")]
    numbered = global_row_number(comments, order, "comment_id").drop("comment_id_total")
    parents = numbered.select("author_id", "post_id", F.col("path").alias("_parent"), F.col("comment_id").alias("_id"))
    c = F.col("content")
    features = tx.comment_features(c, F.col("post_author"), F.col("parent_username"))
    joined = numbered.withColumn("_parent", F.slice("path", F.lit(1), F.size("path") - 1)).join(
        parents, ["author_id", "post_id", "_parent"], "left")
    return joined.select(
        F.col("username").alias("commenter_id"),
        "comment_id",
        F.col("_id").alias("parent_id"),
        "author_id",
        "post_id",
        c.alias("comment_content"),
        *[f.alias(k) for k, f in features.items()],
        F.size("path").cast("bigint").alias("level"),
    )


def tree_depths(df: DataFrame, thread: str, node: str, parent: str) -> DataFrame:
    """T4: depth of every node of trees given as (thread, node, parent) rows, of any depth.

    Pointer doubling: a node that points k steps up takes over where that ancestor points, so a path of n nodes takes
    log2(n) rounds. A round is one join of the nodes still under way, a busy ancestor in several places, and one written
    table. Nodes above which a parent is missing have no depth. After log2 of the number of rows every pointer has
    left its tree, or it runs in a circle.
    """
    start = cut_lineage(df.select(thread, node, F.col(parent).alias("_up"), F.col(parent).isNotNull().cast("bigint").alias("depth")))
    ended, open_ = [start.where("_up IS NULL")], start.where("_up IS NOT NULL")
    rounds = max(1, start.count()).bit_length() + 1
    for _ in range(rounds):
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, ended).select(thread, node, "depth")
        known = reduce(DataFrame.unionByName, [*ended, open_])
        ahead = known.select(thread, F.col(node).alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_more"))
        moved = cut_lineage(join_hot(open_, ahead, [thread, "_up"]).select(
            thread, node, F.col("_next").alias("_up"), (F.col("depth") + F.col("_more")).alias("depth")))
        ended.append(moved.where("_up IS NULL"))
        open_ = moved.where("_up IS NOT NULL")
    raise ValueError("a node is its own ancestor")


def depth_counts(depths: DataFrame) -> DataFrame:
    """T4: direct comments (children of the post) and nested ones."""
    return depths.agg(
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.count_if(F.col("depth") > 1).alias("nested"),
        F.max("depth").alias("deepest"),
    )


def direct_replies(posts: DataFrame) -> DataFrame:
    """T5: number of comments directly below each post."""
    return posts.select("link", reply_count(posts).alias("direct_replies"))


def reply_count(posts: DataFrame) -> Column:
    """T5: the length of a post's list of replies."""
    held = F.from_json(_replies(posts), "array<string>", JSON_DEPTH)
    return F.size(F.coalesce(held, F.array().cast("array<string>"))).cast("bigint")


def engagement(posts: DataFrame, has_comments: Column) -> DataFrame:
    """Post counts, sums, mean likes, and mean views over posts with views."""
    views = F.coalesce(F.col("views"), F.lit(0))
    return posts.agg(
        F.count("*").alias("total_posts"),
        F.count_if(has_comments).alias("posts_with_comments"),
        F.sum("likes").alias("total_likes"),
        F.sum("retweet").alias("total_retweets"),
        F.sum(views).alias("total_views"),
        F.avg("likes").alias("avg_likes"),
        F.avg(F.when(views != 0, views)).alias("avg_views"),
    )


def flat_totals(flat: DataFrame) -> DataFrame:
    """Top-level and reply rows, distinct authors and users."""
    return flat.agg(
        F.count_if(F.col("parent_id") == "").alias("top_level"),
        F.count_if(F.col("parent_id") != "").alias("replies"),
        F.countDistinct("author_id").alias("influencers"),
        F.countDistinct("username").alias("users"),
    )

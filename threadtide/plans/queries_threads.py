"""Thread trees, sources, sinks and streaming over the conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtide.operators import threads as tr
from threadtide.plans import views
from threadtide.plans.registry import query
from threadtide.plans.views import st_sql, table, th_sql
from threadtide.session import fresh_path
from threadtide.sources import files
from threadtide.sources.schemas import COUNTERS

# counters of a turn, derived from its ids and text
COUNTER_SQL = {
    "likes": "length(text)", "retweet": "mod(conv_id * 3 + turn, 11)", "share": "mod(conv_id + turn, 5)",
    "views": "CASE WHEN mod(conv_id + turn, 3) = 0 THEN NULL ELSE length(text) * 7 END", "replies": "turn",
}


def nested_posts(spark, sf):
    """View 2 nested: one post per conversation, all that is below it as JSON text."""
    t = views.threads(spark, sf)
    k = F.col("conv_id") + F.col("turn")
    node = F.struct(
        F.col("turn"), F.col("parent_turn"), F.col("role").alias("username"), F.col("text").alias("content"),
        F.length("text").cast("bigint").alias("likes"), ((F.col("conv_id") * 3 + F.col("turn")) % 11).alias("retweet"),
        (k % 5).alias("share"), F.when(k % 3 != 0, F.length("text").cast("bigint") * 7).alias("views"),
        F.col("turn").alias("replies"),
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("link"),
    )
    # a conversation is a bounded handful of turns
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    own = ("username", "content", *COUNTERS, "link")

    def replies(ready, turn):
        return F.concat(F.lit("["), F.concat_ws(",", F.transform(F.filter(ready, lambda r: r["parent"] == turn), lambda r: r["text"])), F.lit("]"))

    def hang(ready, n):
        """From the last turn to the first: a turn takes the finished replies below it and waits for its parent."""
        text = F.to_json(F.struct(*[n[f].alias(f) for f in own]))
        text = F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(',"replies_content":'), replies(ready, n["turn"]), F.lit("}"))
        done = F.struct(n["parent_turn"].cast("bigint").alias("parent"), text.alias("text"))
        return F.concat(F.array(done), F.filter(ready, lambda r: r["parent"] != n["turn"]))

    below = F.aggregate(F.reverse(F.slice("nodes", 2, F.size("nodes"))), F.array().cast("array<struct<parent:bigint,text:string>>"), hang)
    root = F.element_at("nodes", 1)
    return per.select(
        "conv_id", F.concat(F.lit("acct"), (F.col("conv_id") % 20).cast("string")).alias("author_id"),
        *[root[f].alias(f) for f in own], replies(below, root["turn"]).alias("replies_content"))


FLAT = "fl AS (SELECT 'acct' || CAST(mod(conv_id, 20) AS VARCHAR) AS author_id, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS id, " \
       "role AS username, text AS content, coalesce(CAST(conv_id AS VARCHAR) || '/' || CAST(parent_turn AS VARCHAR), '') AS parent_id, " + \
       ", ".join(f"coalesce({e}, 0) AS {k}" for k, e in COUNTER_SQL.items()) + " FROM th)"


@query("T1_flatten_threads", th_sql(f", {FLAT} SELECT * FROM fl"))
def _(spark, sf):
    return tr.flatten_threads(nested_posts(spark, sf)).drop("path", "parent_username")




def _numbered(spark, sf):
    return tr.numbered_posts(nested_posts(spark, sf), "conv_id")


TREE = f"""WITH RECURSIVE {views.TH},
po AS (SELECT conv_id, 'acct' || CAST(mod(conv_id, 20) AS VARCHAR) AS author_id,
       row_number() OVER (PARTITION BY mod(conv_id, 20) ORDER BY conv_id) AS post_id FROM th WHERE turn = 0),
tr AS (SELECT conv_id, turn, 0 AS depth, CAST([] AS BIGINT[]) AS path, CAST(NULL AS BIGINT) AS parent_turn FROM th WHERE turn = 0
  UNION ALL SELECT c.conv_id, c.turn, p.depth + 1, list_append(p.path, mod(c.turn + 1, 2)), p.turn
  FROM th c JOIN tr p ON c.conv_id = p.conv_id AND c.parent_turn = p.turn),
nu AS (SELECT tr.*, author_id, post_id, row_number() OVER (ORDER BY author_id, post_id, path) AS comment_id
  FROM tr JOIN po ON tr.conv_id = po.conv_id WHERE tr.turn > 0)"""


@query("T2_comments_table", TREE + r"""
SELECT t.role AS commenter_id, nu.comment_id, p.comment_id AS parent_id, nu.author_id, nu.post_id, t.text AS comment_content,
       CAST(nu.depth AS BIGINT) AS level, length(regexp_replace(t.text, '[\x00-\x7F]', '', 'g')) AS num_unicode_chars
FROM nu JOIN th t ON t.conv_id = nu.conv_id AND t.turn = nu.turn
LEFT JOIN nu p ON p.conv_id = nu.conv_id AND p.turn = nu.parent_turn""")
def _(spark, sf):
    return tr.comments_table(_numbered(spark, sf)).select(
        "commenter_id", "comment_id", "parent_id", "author_id", "post_id", "comment_content", "level", "num_unicode_chars")


@query("T3_post_numbers", TREE + " SELECT author_id, conv_id, post_id FROM po")
def _(spark, sf):
    return _numbered(spark, sf).select("author_id", "conv_id", "post_id")


@query("T4_depths", TREE + " SELECT conv_id, turn, CAST(depth AS BIGINT) AS depth FROM tr")
def _(spark, sf):
    return tr.tree_depths(views.threads(spark, sf), "conv_id", "turn", "parent_turn")


@query("T4_depth_counts", TREE + """
SELECT count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS nested, CAST(max(depth) AS BIGINT) AS deepest FROM tr""")
def _(spark, sf):
    return tr.depth_counts(tr.tree_depths(views.threads(spark, sf), "conv_id", "turn", "parent_turn"))


@query("T5_direct_replies", th_sql("""
SELECT CAST(p.conv_id AS VARCHAR) || '/0' AS link, count(c.turn) AS direct_replies
FROM th p LEFT JOIN th c ON c.conv_id = p.conv_id AND c.parent_turn = 0 WHERE p.turn = 0 GROUP BY 1"""))
def _(spark, sf):
    return tr.direct_replies(nested_posts(spark, sf))


@query("T8_engagement", th_sql(f", {FLAT}" + """
SELECT count(*) AS total_posts, count(*) FILTER (id IN (SELECT parent_id FROM fl)) AS posts_with_comments,
       CAST(sum(likes) AS BIGINT) AS total_likes, CAST(sum(retweet) AS BIGINT) AS total_retweets,
       CAST(sum(views) AS BIGINT) AS total_views, round(avg(likes), 9) AS avg_likes,
       round(avg(views) FILTER (views > 0), 9) AS avg_views FROM fl WHERE parent_id = ''"""))
def _(spark, sf):
    posts = nested_posts(spark, sf)
    out = tr.engagement(posts, tr.reply_count(posts) > 0)
    return out.withColumns({c: F.round(c, 9) for c in ("avg_likes", "avg_views")})


@query("T9_flat_totals", th_sql(f", {FLAT}" + """
SELECT count(*) FILTER (parent_id = '') AS top_level, count(*) FILTER (parent_id <> '') AS replies,
       count(DISTINCT author_id) AS influencers, count(DISTINCT username) AS users FROM fl"""))
def _(spark, sf):
    return tr.flat_totals(tr.flatten_threads(nested_posts(spark, sf)))


W5_SQL = TREE + " SELECT conv_id, turn, comment_id FROM nu"


@query("W5_dense_ids", W5_SQL)
def _(spark, sf):
    from threadtide.operators.ranks import global_row_number

    flat = tr.flatten_threads(_numbered(spark, sf)).where(F.size("path") > 0)
    out = global_row_number(flat, [F.col("author_id"), F.col("post_id"), F.col("path")], "comment_id")
    ids = F.split("id", "/")
    return out.select(ids[0].cast("bigint").alias("conv_id"), ids[1].cast("bigint").alias("turn"),
                      F.col("comment_id").cast("bigint").alias("comment_id"))


# ------------------------------------------------------------------------------- S: sources and sinks

def thread_files(spark, sf, bad: bool = False) -> str:
    """The nested posts as JSON, one post per line, a folder per author; optionally with broken lines."""
    path = fresh_path(spark, "threads")
    own = F.to_json(F.struct("username", "content", *COUNTERS, "link"))
    line = F.concat(F.substr(own, F.lit(1), F.length(own) - 1), F.lit(',"replies_content":'), "replies_content", F.lit("}"))
    lines = nested_posts(spark, sf).select("author_id", "conv_id", line.alias("value"))
    if bad:
        broken = F.when(F.col("conv_id") % 10 == 3, F.concat(F.lit('{"username": '), F.col("conv_id").cast("string"), F.lit(", oops")))
        empty = F.when(F.col("conv_id") % 10 == 4, "{}")
        lines = lines.withColumn("value", F.coalesce(broken, empty, F.col("value")))
    lines.select("author_id", "value").write.partitionBy("author_id").text(path)
    return path


@query("S1_read_threads", th_sql(f", {FLAT} SELECT * FROM fl"))
def _(spark, sf):
    posts, _ = files.read_threads(spark, thread_files(spark, sf), multi_line=False, author_from_file=False)
    return tr.flatten_threads(posts).drop("path", "parent_username")


@query("S2_bad_records", "SELECT count(DISTINCT conv_id) AS bad_records FROM conversations WHERE mod(conv_id, 10) = 3")
def _(spark, sf):
    path = thread_files(spark, sf, bad=True)
    _, bad = files.read_threads(spark, path, multi_line=False, author_from_file=False)
    return bad.agg(F.count("*").alias("bad_records"))


@query("S3_skip_empty", "SELECT count(DISTINCT conv_id) AS posts FROM conversations WHERE mod(conv_id, 10) NOT IN (3, 4)")
def _(spark, sf):
    path = thread_files(spark, sf, bad=True)
    posts, _ = files.read_threads(spark, path, multi_line=False, author_from_file=False)
    return posts.agg(F.count("*").alias("posts"))


@query("S4_csv_scan", st_sql("SELECT doc_id, content FROM st"))
def _(spark, sf):
    path = fresh_path(spark, "csv")
    files.write_csv(views.social_text(spark, sf), path, ["doc_id", "lang", "author", "content"])
    return files.read_csv(spark, path, "doc_id bigint, lang string, author string, content string", ["doc_id", "content"])


@query("S5_csv_sink", """
SELECT doc_id, lang, text || chr(10) || '"q", ' || lang AS text FROM documents""")
def _(spark, sf):
    path = fresh_path(spark, "csv")
    docs = table(spark, sf, "documents").select(
        "lang", "doc_id", F.concat("text", F.lit('\n"q", '), "lang").alias("text"))
    files.write_csv(docs, path, ["doc_id", "lang", "text"])
    return files.read_csv(spark, path, "doc_id bigint, lang string, text string")


@query("S6_snapshot_to_csv", """
SELECT vec_id, label, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 5) AS total FROM embeddings""")
def _(spark, sf):
    snapshot, path = fresh_path(spark, "snapshot"), fresh_path(spark, "csv")
    files.write_snapshot(table(spark, sf, "embeddings"), snapshot)
    flat = files.flat_for_csv(spark.read.parquet(snapshot))
    files.write_csv(flat, path, flat.columns)
    back = files.read_csv(spark, path, "vec_id bigint, embedding string, label int")
    vec = F.from_json("embedding", "array<double>")
    total = F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v.cast("float").cast("double"))
    return back.select("vec_id", "label", F.size(vec).cast("bigint").alias("dims"), F.round(total, 5).alias("total"))


@query("S7_scalar_columns", "SELECT vec_id, label FROM embeddings")
def _(spark, sf):
    return files.scalar_columns(table(spark, sf, "embeddings"))


@query("S9_grid_output", views.sc_sql("""
, g(t) AS (VALUES (0.05e0), (0.1e0), (0.25e0), (0.5e0)), m(min_comments) AS (VALUES (2), (5), (10)),
c AS (SELECT t, commenter_id, count(*) AS n FROM sc, g WHERE ai_confidence <= t OR ai_confidence >= 1e0 - t GROUP BY ALL)
SELECT min_comments, t AS threshold, count(*) AS users, CAST(sum(n) AS BIGINT) AS rows_kept FROM c JOIN m ON n >= min_comments GROUP BY ALL"""))
def _(spark, sf):
    from threadtide.operators.users import grid_user_labels

    path = fresh_path(spark, "grid")
    files.write_grid(grid_user_labels(views.scored_comments(spark, sf), (2, 5, 10), (0.05, 0.1, 0.25, 0.5)), path,
                     ["min_comments", "threshold"])
    return spark.read.parquet(path).groupBy("min_comments", "threshold").agg(
        F.count("*").alias("users"), F.sum("num_comments").alias("rows_kept"))


@query("S10_text_lines", r"SELECT regexp_replace(text, '\r\n|[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]', ' ', 'g') AS line FROM documents")
def _(spark, sf):
    path = fresh_path(spark, "lines")
    files.write_lines(table(spark, sf, "documents"), "text", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# ------------------------------------------------------------------------------- ST: streaming

@query("ST1_ingest_threads", th_sql(f", {FLAT}" + r"""
SELECT author_id, id, username, parent_id, length(regexp_replace(content, '[\x00-\x7F]', '', 'g')) AS num_unicode_chars FROM fl"""))
def _(spark, sf):
    from threadtide.streaming import jobs

    sink = fresh_path(spark, "ingested")
    jobs.ingest_threads(spark, thread_files(spark, sf), sink, fresh_path(spark, "state"),
                        multi_line=False, author_from_file=False)
    return spark.read.parquet(sink).select("author_id", "id", "username", "parent_id", "num_unicode_chars")


@query("ST1_bad_records", "SELECT count(DISTINCT conv_id) AS bad_records FROM conversations WHERE mod(conv_id, 10) = 3")
def _(spark, sf):
    from threadtide.streaming import jobs

    sink = fresh_path(spark, "ingested")
    jobs.ingest_threads(spark, thread_files(spark, sf, bad=True), sink, fresh_path(spark, "state"),
                        multi_line=False, author_from_file=False)
    return spark.read.parquet(f"{sink}.bad").agg(F.count("*").alias("bad_records"))


@query("S8_append_total", "SELECT count(*) AS rows FROM conversations")
def _(spark, sf):
    from threadtide.streaming import jobs

    source, sink, state = thread_files(spark, sf), fresh_path(spark, "ingested"), fresh_path(spark, "state")
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest_threads(spark, source, sink, state, multi_line=False, author_from_file=False)
    return jobs.ingested_total(spark, sink)


@query("ST3_running_totals", views.sc_sql("""
SELECT sentiment_label, count(*) AS comments, count(*) FILTER (hate_label = 'HATE') AS hate_comments,
       count(*) FILTER (offensive_label = 'offensive') AS offensive_comments FROM sc GROUP BY 1"""))
def _(spark, sf):
    from threadtide.streaming import jobs

    source, sink = fresh_path(spark, "scored"), fresh_path(spark, "totals")
    views.scored_comments(spark, sf).write.parquet(source)
    schema = views.scored_comments(spark, sf).schema
    jobs.running_totals(spark.readStream.schema(schema).parquet(source), sink, fresh_path(spark, "state"))
    return jobs.latest_totals(spark, sink)

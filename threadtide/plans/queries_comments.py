"""Projections, filters, joins, samples and data-quality checks over the scored comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtide.functions import index as ix
from threadtide.operators import quality, ranks, reports, sampling, users
from threadtide.plans.registry import query
from threadtide.plans.views import (
    LEANING, POSTS, SC, indexed_comments, leaning, posts, sc_sql, scored_comments, table,
)

r9 = lambda c, name: F.round(c, 9).alias(name)


# ------------------------------------------------------------------------------- P: projections

@query("P1_two_sided_confidence", sc_sql("""
SELECT comment_id, ai_confidence FROM sc WHERE ai_confidence <= 0.1e0 OR ai_confidence >= 0.9e0"""))
def _(spark, sf):
    df = scored_comments(spark, sf)
    return df.where(ix.confident(F.col("ai_confidence"), 0.1)).select("comment_id", "ai_confidence")


@query("P2_kept_percentage", sc_sql("""
SELECT t.low, t.high, count(*) AS original,
       count(*) FILTER (ai_confidence >= t.high OR ai_confidence <= t.low) AS kept,
       round(count(*) FILTER (ai_confidence >= t.high OR ai_confidence <= t.low) * 100e0 / count(*), 9) AS pct_kept
FROM sc, (VALUES (0.3e0, 0.7e0), (0.15e0, 0.85e0), (0.1e0, 0.9e0), (0.05e0, 0.95e0), (0.025e0, 0.975e0),
                 (0.01e0, 0.99e0)) t(low, high) GROUP BY ALL"""))
def _(spark, sf):
    bounds = [(0.3, 0.7), (0.15, 0.85), (0.1, 0.9), (0.05, 0.95), (0.025, 0.975), (0.01, 0.99)]
    c = F.col("ai_confidence")
    row = scored_comments(spark, sf).agg(
        F.count("*").alias("original"),
        *[F.count_if(ix.confident_between(c, lo, hi)).alias(f"k{i}") for i, (lo, hi) in enumerate(bounds)],
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.col(f"k{i}").alias("kept"))
        for i, (lo, hi) in enumerate(bounds)
    ]))
    return row.select("original", cells.alias("x")).select(
        "x.low", "x.high", "original", "x.kept", r9(F.col("x.kept") * 100.0 / F.col("original"), "pct_kept"))


@query("P3_strict_confidence", sc_sql("""
SELECT comment_id, ai_confidence FROM sc WHERE ai_confidence > 0.9e0 OR ai_confidence < 0.1e0"""))
def _(spark, sf):
    df = scored_comments(spark, sf)
    return df.where(ix.strictly_confident(F.col("ai_confidence"))).select("comment_id", "ai_confidence")


@query("P4_one_sided_confidence", sc_sql("""
SELECT t.t AS threshold, label, count(*) AS n, round(avg(rbi), 9) AS mean_rbi
FROM x, (VALUES (0.5e0), (0.7e0), (0.9e0)) t(t) WHERE ai_confidence >= t.t GROUP BY ALL"""))
def _(spark, sf):
    from threadtide.operators.stats import by_threshold

    rows = by_threshold(indexed_comments(spark, sf), "ai_confidence", (0.5, 0.7, 0.9))
    return rows.groupBy("threshold", "label").agg(F.count("*").alias("n"), r9(F.avg("rbi"), "mean_rbi"))


@query("P5_label_numbers", sc_sql("""
SELECT comment_id, label AS from_text,
       CAST(dense_rank() OVER (ORDER BY sentiment_label) - 1 AS BIGINT) AS sentiment_index FROM sc"""))
def _(spark, sf):
    df = scored_comments(spark, sf).withColumn("text_label", F.concat(F.lit("LABEL_"), F.col("label").cast("string")))
    levels = df.agg(F.array_sort(F.collect_set("sentiment_label"))).scalar()  # a handful of class names
    return df.select(
        "comment_id",
        ix.numeric_label(F.col("text_label")).alias("from_text"),
        (F.array_position(levels, F.col("sentiment_label")) - 1).cast("bigint").alias("sentiment_index"),
    )


@query("P6_signed_sentiment", sc_sql("SELECT comment_id, round(s, 9) AS s FROM x"))
def _(spark, sf):
    return indexed_comments(spark, sf).select("comment_id", r9(F.col("s"), "s"))


@query("P7_rage_component", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 9) AS rage_first,
       round((CAST(embedding[3] AS DOUBLE) + CAST(embedding[8] AS DOUBLE) + CAST(embedding[14] AS DOUBLE)
            + CAST(embedding[33] AS DOUBLE) + CAST(embedding[64] AS DOUBLE)) / 5, 9) AS rage_mean
FROM embeddings""")
def _(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", r9(ix.rage_first(v), "rage_first"),
        # position 130 lies beyond these 64-element vectors and is skipped, as the rule says
        r9(ix.rage_mean(v, [2, 7, 13, 32, 63, 130]), "rage_mean"))


@query("P8_rage_bait_index", sc_sql("SELECT comment_id, round(rbi, 9) AS rbi FROM x"))
def _(spark, sf):
    return indexed_comments(spark, sf).select("comment_id", r9(F.col("rbi"), "rbi"))


@query("P9_calibrated_index", sc_sql("""
SELECT comment_id, round(0.4e0 * rage + 0.3e0 * offensive_prob + 0.3e0 * hate_prob, 9) AS rbi_calibrated FROM sc"""))
def _(spark, sf):
    c = ix.calibrated_index(F.col("rage"), F.col("offensive_prob"), F.col("hate_prob"))
    return scored_comments(spark, sf).select("comment_id", r9(c, "rbi_calibrated"))


@query("P10_dashboard_coordinates", sc_sql("""
SELECT comment_id, round(t, 9) AS toxicity, round(c, 9) AS capped_index, round(t * 20 - 10, 9) AS x,
       round(c * 15, 9) AS y, round(s * 10, 6) AS z, colour
FROM (SELECT comment_id, s, (hate_prob + offensive_prob) / 2 AS t,
             least(1e0, (irony_prob / 1e1 + rage + hate_prob / 1e1 + offensive_prob / 1e1) * 2) AS c,
             CASE WHEN hate_label = 'HATE' THEN 'red' WHEN offensive_label = 'offensive' THEN 'orange'
                  WHEN sentiment_label = 'negative' THEN 'blue' WHEN sentiment_label = 'positive' THEN 'green'
                  ELSE 'gray' END AS colour FROM x) q"""))
def _(spark, sf):
    ten = F.lit(10.0)
    cols = ix.dashboard_columns(F.col("irony_prob") / ten, F.col("rage"), F.col("hate_prob") / ten,
                                F.col("offensive_prob") / ten)
    return scored_comments(spark, sf).select(
        "comment_id", *[(c if k == "colour" else F.round(c, 9)).alias(k) for k, c in cols.items()])


@query("P11_emotion_vector", sc_sql("""
SELECT comment_id, round(s + hate_prob * 2 + offensive_prob * 3 + rage * 4 + irony_prob * 5, 9) AS checksum,
       CAST(5 AS BIGINT) AS dims FROM x"""))
def _(spark, sf):
    v = F.array("s", "hate_prob", "offensive_prob", "rage", "irony_prob")
    total = sum((F.element_at(F.col("e"), i) * i for i in range(2, 6)), F.element_at(F.col("e"), 1))
    return indexed_comments(spark, sf).select("comment_id", v.alias("e")).select(
        "comment_id", r9(total, "checksum"), F.size("e").cast("bigint").alias("dims"))


@query("P12_pack_and_unpack", """
SELECT vec_id, """ + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS v{i}" for i in range(64)) + """
FROM embeddings""")
def _(spark, sf):
    from threadtide.operators import vectors

    wide = vectors.unpack(table(spark, sf, "embeddings"), "embedding", 64, "v")
    packed = vectors.pack(wide, [f"v{i}" for i in range(64)], "packed")
    return vectors.unpack(packed.select("vec_id", "packed"), "packed", 64, "v")


@query("P15_comment_count_bins", sc_sql("""
, c AS (SELECT commenter_id, count(*) AS n FROM sc GROUP BY 1),
b(bin_order, bin, lo, hi) AS (VALUES (0, '1', 1, 1), (1, '2', 2, 2), (2, '3', 3, 3), (3, '4', 4, 4),
                              (4, '5-10', 5, 10), (5, '>10', 11, 9999999999))
SELECT CAST(bin_order AS BIGINT) AS bin_order, bin, count(c.n) AS num_users
FROM b LEFT JOIN c ON n BETWEEN lo AND hi GROUP BY ALL"""))
def _(spark, sf):
    return reports.count_bins(scored_comments(spark, sf))


@query("P16_user_status", sc_sql("""
SELECT commenter_id, author_id, post_id,
       CASE WHEN h > 0 THEN 'FLAGGED' WHEN (h + o) * 1e0 / n > 0.3e0 THEN 'MONITOR' ELSE 'NORMAL' END AS status
FROM (SELECT commenter_id, author_id, post_id, count(*) AS n, count(*) FILTER (hate_label = 'HATE') AS h,
             count(*) FILTER (offensive_label = 'offensive') AS o
      FROM sc GROUP BY ALL) q"""))
def _(spark, sf):
    # users below one post: few comments each, so that all three answers occur
    keys = ("commenter_id", "author_id", "post_id")
    h, o = F.count_if(F.col("hate_label") == "HATE"), F.count_if(F.col("offensive_label") == "offensive")
    per = scored_comments(spark, sf).groupBy(*keys).agg(h.alias("h"), o.alias("o"), F.count("*").alias("n"))
    return per.select(*keys, ix.user_status(F.col("h"), (F.col("h") + F.col("o")) / F.col("n")).alias("status"))


@query("P17_user_search", sc_sql("""
SELECT commenter_id, comments, round(avg_hate, 9) AS avg_hate
FROM (SELECT commenter_id, count(*) AS comments, sum(hate_prob) / count(*) AS avg_hate FROM sc
      WHERE length(commenter_id) BETWEEN 1 AND 30 GROUP BY 1) q
WHERE contains(lower(commenter_id), 'u1') ORDER BY round(avg_hate, 9) DESC, commenter_id LIMIT 100"""))
def _(spark, sf):
    found = reports.search_users(reports.dashboard_users(scored_comments(spark, sf)), "U1", "hate")
    return found.select("commenter_id", "comments", r9(F.col("avg_hate"), "avg_hate"))


@query("P18_row_sanity", """
SELECT c_custkey, c_name FROM customer WHERE c_name IS NOT NULL AND length(c_name) > 0 AND length(c_name) <= 30""")
def _(spark, sf):
    return quality.sane_ids(table(spark, sf, "customer"), "c_name", 30).select("c_custkey", "c_name")


@query("P19_defaults", sc_sql("""
SELECT comment_id, CASE WHEN mod(comment_id, 3) = 0 THEN 'neutral' ELSE sentiment_label END AS sentiment_label,
       CASE WHEN mod(comment_id, 5) = 0 THEN 0e0 ELSE hate_prob END AS hate_prob,
       mod(comment_id, 2) = 0 AS tagged FROM sc"""))
def _(spark, sf):
    k = F.col("comment_id")
    raw = scored_comments(spark, sf).select(
        "comment_id",
        F.when(k % 3 == 0, F.when(k % 2 == 0, "")).otherwise(F.col("sentiment_label")).alias("sentiment_label"),
        F.when(k % 5 == 0, "n/a").otherwise(F.col("hate_prob").cast("string")).alias("hate_prob"),
        F.when(k % 2 == 0, F.when(k % 4 == 0, "True").otherwise("1")).otherwise("no").alias("tagged"),
    )
    return raw.select(
        "comment_id",
        ix.or_default(F.col("sentiment_label"), "neutral").alias("sentiment_label"),
        ix.number_or_zero(F.col("hate_prob")).alias("hate_prob"),
        ix.parse_flag(F.col("tagged")).alias("tagged"),
    )


@query("P20_binarise", sc_sql("""
SELECT CASE WHEN ai_confidence >= 0.5e0 THEN 1 ELSE 0 END AS predicted, label, count(*) AS n FROM sc GROUP BY ALL"""))
def _(spark, sf):
    predicted = F.when(F.col("ai_confidence") >= 0.5, 1).otherwise(0).alias("predicted")
    return scored_comments(spark, sf).groupBy(predicted, "label").agg(F.count("*").alias("n"))


@query("P21_effect_size", sc_sql("""
SELECT comment_id, CASE WHEN abs(s) < 0.147e0 THEN 'Negligible' WHEN abs(s) < 0.33e0 THEN 'Small'
       WHEN abs(s) < 0.474e0 THEN 'Medium' ELSE 'Large' END AS effect,
       CASE WHEN s > 0 THEN 'Bots > Humans' ELSE 'Humans > Bots' END AS direction FROM x"""))
def _(spark, sf):
    return indexed_comments(spark, sf).select(
        "comment_id", ix.effect_size(F.col("s")).alias("effect"), ix.effect_direction(F.col("s")).alias("direction"))


@query("P22_significance_stars", sc_sql("""
SELECT comment_id, CASE WHEN p < 0.001e0 THEN '***' WHEN p < 0.01e0 THEN '**' WHEN p < 0.05e0 THEN '*' ELSE 'ns' END
       AS stars FROM (SELECT comment_id, irony_prob * irony_prob AS p FROM sc) q"""))
def _(spark, sf):
    p = F.col("irony_prob") * F.col("irony_prob")
    return scored_comments(spark, sf).select("comment_id", ix.stars(p).alias("stars"))


@query("P23_robustness_class", sc_sql("""
SELECT author_id, post_id, round(p, 9) AS pct, CASE WHEN p >= 95 THEN 'ROBUST' WHEN p >= 80 THEN 'SENSITIVE'
       ELSE 'NOT ROBUST' END AS class
FROM (SELECT author_id, post_id, 100e0 * count(*) FILTER (irony_prob < 0.9e0) / count(*) AS p FROM sc GROUP BY ALL) q"""))
def _(spark, sf):
    p = F.count_if(F.col("irony_prob") < 0.9) * 100.0 / F.count("*")
    per = scored_comments(spark, sf).groupBy("author_id", "post_id").agg(p.alias("p"))
    return per.select("author_id", "post_id", r9(F.col("p"), "pct"), ix.robustness_class(F.col("p")).alias("class"))


@query("T6_root_test", sc_sql("""
SELECT count(*) AS n, count(*) FILTER (parent_id IS NULL) AS roots,
       count(*) FILTER (parent_id IS NULL OR parent_id = post_id) AS roots_literal FROM sc"""))
def _(spark, sf):
    return scored_comments(spark, sf).agg(
        F.count("*").alias("n"),
        F.count_if(ix.is_root(F.col("parent_id"))).alias("roots"),
        F.count_if(ix.is_root(F.col("parent_id"), F.col("post_id"))).alias("roots_literal"))


@query("T7_replies_only", sc_sql("SELECT comment_id, parent_id FROM sc WHERE parent_id IS NOT NULL"))
def _(spark, sf):
    return scored_comments(spark, sf).where("parent_id IS NOT NULL").select("comment_id", "parent_id")


# ------------------------------------------------------------------------------- J: joins

@query("J1_leaning_join", f"""WITH {SC}, {LEANING}, {POSTS}
SELECT l.leaning, count(*) AS comments, count(DISTINCT x.author_id) AS authors,
       count(DISTINCT x.author_id || '|' || CAST(x.post_id AS VARCHAR)) AS posts, round(avg(rbi), 9) AS mean_rbi
FROM x JOIN posts p ON x.author_id = p.author_id AND x.post_id = p.post_id
       JOIN leaning l ON p.author_id = l.author_id GROUP BY 1""")
def _(spark, sf):
    from threadtide.operators.joins import with_leaning

    joined = with_leaning(indexed_comments(spark, sf), posts(spark, sf), leaning(spark, sf))
    return joined.groupBy("leaning").agg(
        F.count("*").alias("comments"), F.countDistinct("author_id").alias("authors"),
        F.countDistinct("author_id", "post_id").alias("posts"), r9(F.avg("rbi"), "mean_rbi"))


@query("J1_trade_join", """
SELECT n_name, count(*) AS orders, count(DISTINCT o_custkey) AS customers,
       round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    # Orders are folded by customer before the join, so a heavy customer crosses the network once.
    per = o.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("t"))
    return (
        per.join(c, per.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
        .groupBy("n_name")
        .agg(F.sum("k").alias("orders"), F.count("*").alias("customers"), F.round(F.sum("t"), 2).alias("total"))
    )


@query("J2_key_concat", """
SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, sf):
    from threadtide.operators.joins import concat_columns

    return concat_columns(
        table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("J4_suffix_merge", sc_sql("""
SELECT a.comment_id, a.ai_confidence, b.rbi AS rbi_proc, b.ai_confidence AS ai_confidence_proc
FROM sc a JOIN (SELECT comment_id, round(rbi, 9) AS rbi, 1 - ai_confidence AS ai_confidence FROM x) b
  ON a.comment_id = b.comment_id"""))
def _(spark, sf):
    from threadtide.operators.joins import merge_with_suffix

    left = scored_comments(spark, sf).select("comment_id", "ai_confidence")
    right = indexed_comments(spark, sf).select(
        "comment_id", F.round("rbi", 9).alias("rbi"), (1 - F.col("ai_confidence")).alias("ai_confidence"))
    return merge_with_suffix(left, right, "comment_id", "_proc").withColumnRenamed("rbi", "rbi_proc")


@query("J5_left_align", """
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, sf):
    from threadtide.operators.joins import bring_columns

    return bring_columns(
        table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id", ["quality"])


@query("J6_roots_with_replies", sc_sql("""
SELECT r.comment_id, r.label, count(*) AS n_replies, round(avg(c.offensive_prob), 9) AS reply_offensive
FROM x r JOIN x c ON c.parent_id = r.comment_id WHERE r.parent_id IS NULL GROUP BY ALL"""))
def _(spark, sf):
    from threadtide.operators.joins import roots_with_replies

    return roots_with_replies(
        indexed_comments(spark, sf), {"reply_offensive": F.avg("offensive_prob")}
    ).select("comment_id", "label", "n_replies", r9(F.col("reply_offensive"), "reply_offensive"))


@query("J7_active_users", sc_sql("""
SELECT commenter_id, count(*) AS n FROM sc WHERE commenter_id IN
  (SELECT commenter_id FROM sc GROUP BY 1 HAVING count(*) >= 70) GROUP BY 1"""))
def _(spark, sf):
    kept = users.active_users(scored_comments(spark, sf), 70)
    return kept.groupBy("commenter_id").agg(F.count("*").alias("n"))


@query("J8_rows_of_top_users", sc_sql("""
SELECT comment_id, commenter_id FROM sc WHERE commenter_id IN
  (SELECT commenter_id FROM sc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)"""))
def _(spark, sf):
    return users.rows_of_top_users(scored_comments(spark, sf), 20).select("comment_id", "commenter_id")


@query("J9_not_yet_labelled", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    from threadtide.operators.labelling import unlabelled

    return unlabelled(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "lang")


@query("J15_polarisation_leaning", f"""WITH {SC}, {LEANING}
SELECT r.comment_id, l.leaning, round(e.ev, 9) AS ev
FROM sc r JOIN (SELECT parent_id, var_pop(s) + var_pop(offensive_prob) AS ev FROM x WHERE parent_id IS NOT NULL
                GROUP BY 1 HAVING count(*) >= 2) e ON e.parent_id = r.comment_id
LEFT JOIN leaning l ON l.author_id = r.author_id WHERE r.parent_id IS NULL""")
def _(spark, sf):
    from threadtide.operators.stats import roots_with_variance

    roots = roots_with_variance(indexed_comments(spark, sf), "s", "offensive_prob", population=True)
    return roots.join(leaning(spark, sf), "author_id", "left").select("comment_id", "leaning", r9(F.col("ev"), "ev"))


# ------------------------------------------------------------------------------- Q: quality

@query("Q2_missing_values", sc_sql("""
SELECT 'parent_id' AS "column", count(*) - count(parent_id) AS missing FROM sc
UNION ALL SELECT 'label', count(*) - count(label) FROM sc
UNION ALL SELECT 'ai_confidence', count(*) - count(ai_confidence) FROM sc"""))
def _(spark, sf):
    return quality.missing_values(scored_comments(spark, sf), ["parent_id", "label", "ai_confidence"])


@query("Q3_row_count_gate", """
SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows,
       (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS equal""")
def _(spark, sf):
    return quality.row_count_gate(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("Q5_key_uniqueness", """
SELECT text, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    return quality.repeated_keys(table(spark, sf, "documents"), "text")


@query("Q6_sample_guards", sc_sql("""
SELECT author_id, post_id, n1, n0, CASE WHEN n1 > 10 AND n0 > 10 AND post_id <= 10 THEN NULL ELSE 'insufficient' END AS error,
       CASE WHEN n1 > 10 AND n0 > 10 AND post_id <= 10 THEN round(d, 9) END AS difference
FROM (SELECT author_id, post_id, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0,
             avg(CASE WHEN label = 1 THEN rbi END) - avg(CASE WHEN label = 0 THEN rbi END) AS d
      FROM x GROUP BY ALL) q"""))
def _(spark, sf):
    rows = indexed_comments(spark, sf)
    per = rows.groupBy("author_id", "post_id").agg(
        F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"),
        (F.avg(F.when(F.col("label") == 1, F.col("rbi"))) - F.avg(F.when(F.col("label") == 0, F.col("rbi")))).alias("d"))
    ok = (F.col("n1") > 10) & (F.col("n0") > 10) & (F.col("post_id") <= 10)
    return quality.guarded(per, ok, {"difference": F.round("d", 9)}).select("author_id", "post_id", "n1", "n0", "error", "difference")


@query("Q7_drop_incomplete", sc_sql("SELECT comment_id, parent_id, label FROM sc WHERE parent_id IS NOT NULL"))
def _(spark, sf):
    return quality.complete_rows(scored_comments(spark, sf), ["parent_id", "label"]).select(
        "comment_id", "parent_id", "label")


@query("Q8_finite_or_zero", sc_sql("""
SELECT comment_id, CASE mod(comment_id, 4) WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 WHEN 2 THEN 0e0 ELSE rage END AS r FROM sc"""))
def _(spark, sf):
    k = F.col("comment_id") % 4
    raw = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 3, F.col("rage"))
    return scored_comments(spark, sf).select("comment_id", ix.finite_or_zero(raw).alias("r"))


# ------------------------------------------------------------------------------- W: order and samples

@query("W1_nlargest", sc_sql("""
SELECT commenter_id, round(m, 9) AS rbi FROM (SELECT commenter_id, avg(rbi) AS m FROM x GROUP BY 1) q
ORDER BY round(m, 9) DESC, commenter_id LIMIT 10"""))
def _(spark, sf):
    stats = users.user_stats(indexed_comments(spark, sf))
    top = stats.orderBy(F.desc(F.round("rbi", 9)), "commenter_id").limit(10)
    return top.select("commenter_id", r9(F.col("rbi"), "rbi"))


@query("W2_top_users", sc_sql("""
SELECT commenter_id, count(*) AS comments FROM sc WHERE length(commenter_id) BETWEEN 1 AND 29 GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 20"""))
def _(spark, sf):
    return reports.top_users(scored_comments(spark, sf))


@query("W3_mid_ranks", sc_sql("""
SELECT comment_id, rank() OVER (ORDER BY rage) + (count(*) OVER (PARTITION BY rage) - 1) / 2e0 AS rank FROM sc"""))
def _(spark, sf):
    return ranks.with_mid_ranks(scored_comments(spark, sf), "rage", "rank").select("comment_id", "rank")


EDGES = """e AS (SELECT list_sort(list_distinct(quantile_cont(m, [0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0,
                 0.8e0, 0.9e0, 1e0]))) AS edges FROM u)"""


@query("W4_quantile_cut", f"""WITH {SC}, u AS (SELECT comment_id, irony_prob AS m FROM sc), {EDGES}
SELECT comment_id, CAST(greatest(len(list_filter(edges, lambda v: v < m)) - 1, 0) AS BIGINT) AS bin FROM u, e""")
def _(spark, sf):
    rows = scored_comments(spark, sf).select("comment_id", "irony_prob")
    return ranks.quantile_cut(rows, "irony_prob", 10, "bin").select("comment_id", "bin")


@query("W6_keep_first", """
SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text""")
def _(spark, sf):
    return sampling.keep_first(table(spark, sf, "documents").select("doc_id", "text", "lang"), ["text"], "doc_id")


@query("W7_random_rows", """
SELECT doc_id, lang FROM documents ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50""")
def _(spark, sf):
    return sampling.random_rows(table(spark, sf, "documents"), "doc_id", 50).select("doc_id", "lang")


@query("W7_fraction", """
SELECT doc_id FROM documents
WHERE CAST('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 7) AS BIGINT) < CAST(floor(0.05e0 * 268435456) AS BIGINT)""")
def _(spark, sf):
    return sampling.fraction(table(spark, sf, "documents"), "doc_id", 0.05).select("doc_id")


@query("W8_balanced_sample", sc_sql("""
SELECT comment_id, label FROM (SELECT comment_id, label, row_number() OVER (PARTITION BY label
  ORDER BY md5('42|' || CAST(comment_id AS VARCHAR)), comment_id) AS r FROM sc) q WHERE r <= 500"""))
def _(spark, sf):
    return sampling.balanced_sample(scored_comments(spark, sf), "label", "comment_id", 500).select("comment_id", "label")


def _split_sql(edges: list[tuple[str, str]], last: str) -> str:
    cases = " ".join(f"WHEN q < {e} THEN '{p}'" for p, e in edges)
    return sc_sql(f"""
SELECT comment_id, label, CASE {cases} ELSE '{last}' END AS part
FROM (SELECT comment_id, label, (rank() OVER (PARTITION BY label ORDER BY h) - 1) * 1e0
             / count(*) OVER (PARTITION BY label) AS q
      FROM (SELECT *, CAST('0x' || substr(md5('42|' || CAST(comment_id AS VARCHAR)), 1, 12) AS BIGINT) AS h FROM sc) s) t""")


@query("W9_split_80_20", _split_sql([("train", "0.8e0")], "test"))
def _(spark, sf):
    out = sampling.stratified_split(scored_comments(spark, sf), "label", "comment_id", {"train": 0.8, "test": 0.2})
    return out.select("comment_id", "label", "part")


@query("W9_split_60_20_20", _split_sql([("train", "0.6e0"), ("val", "0.8e0")], "test"))
def _(spark, sf):
    shares = {"train": 0.6, "val": 0.2, "test": 0.2}
    out = sampling.stratified_split(scored_comments(spark, sf), "label", "comment_id", shares)
    return out.select("comment_id", "label", "part")


@query("W10_first_rows", sc_sql("SELECT comment_id, commenter_id FROM sc ORDER BY comment_id LIMIT 5000"))
def _(spark, sf):
    return scored_comments(spark, sf).select("comment_id", "commenter_id").orderBy("comment_id").limit(5000)


@query("W11_sorted_proportions", sc_sql("""
SELECT commenter_id, p0, p1, CAST(row_number() OVER (ORDER BY p0 DESC, p1 DESC, commenter_id) AS BIGINT) AS place FROM (
  SELECT commenter_id, round(count(*) FILTER (label = 0) * 1e0 / count(*), 9) AS p0,
         round(count(*) FILTER (label = 1) * 1e0 / count(*), 9) AS p1 FROM sc GROUP BY 1) q"""))
def _(spark, sf):
    tab = reports.cross_tab(scored_comments(spark, sf), "commenter_id", "label", [0, 1]).select(
        "commenter_id", r9(F.col("share_label_0"), "p0"), r9(F.col("share_label_1"), "p1"))
    numbered = ranks.global_row_number(tab, [F.desc("p0"), F.desc("p1"), F.asc("commenter_id")], "place")
    return numbered.select("commenter_id", "p0", "p1", F.col("place").cast("bigint").alias("place"))


@query("W12_best_row", sc_sql("""
SELECT post_id, arg_max(comment_id, rbi * 1e6 - comment_id / 1e6) AS comment_id, round(max(rbi), 9) AS rbi FROM x GROUP BY 1"""))
def _(spark, sf):
    best = F.max_by("comment_id", F.col("rbi") * 1e6 - F.col("comment_id") / 1e6)
    return indexed_comments(spark, sf).groupBy("post_id").agg(best.alias("comment_id"), r9(F.max("rbi"), "rbi"))


@query("W13_per_user_sample", sc_sql("""
SELECT commenter_id, comment_id FROM (SELECT commenter_id, comment_id, row_number() OVER (PARTITION BY commenter_id
  ORDER BY md5('42|' || CAST(comment_id AS VARCHAR)), comment_id) AS r FROM sc) q WHERE r <= 20"""))
def _(spark, sf):
    return sampling.per_user_sample(scored_comments(spark, sf), "commenter_id", "comment_id", 20).select(
        "commenter_id", "comment_id")


@query("W14_top_rows_by_array_sum", """
SELECT vec_id, round(s, 9) AS total FROM (
  SELECT vec_id, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS s FROM embeddings) q
ORDER BY s DESC, vec_id LIMIT 200""")
def _(spark, sf):
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", total.alias("s"))
    return rows.orderBy(F.desc("s"), "vec_id").limit(200).select("vec_id", r9(F.col("s"), "total"))


@query("W15_background_rows", """
SELECT vec_id, label FROM embeddings ORDER BY md5('7|' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 100""")
def _(spark, sf):
    return sampling.random_rows(table(spark, sf, "embeddings"), "vec_id", 100, seed=7).select("vec_id", "label")

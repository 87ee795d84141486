"""User roll-ups, reports, rank tests, variance analysis and evaluation metrics over the scored comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtide.functions import index as ix
from threadtide.operators import evaluate, ranks, reports, stats, users
from threadtide.plans.registry import query
from threadtide.plans.sqltext import f_tail, normal_tail, threshold_sql, u_test
from threadtide.plans.views import LEANING, SC, indexed_comments, leaning, sc_sql, scored_comments, table

r9 = lambda c, name: F.round(c, 9).alias(name)


# Columns whose size or tail approximation leaves fewer common digits than the default nine.
COARSE = dict.fromkeys(
    ("ss_between", "ss_within", "sum_sq", "ss_residual", "f_stat", "z", "t", "p_value", "slope", "intercept",
     "bot_efficiency", "human_efficiency", "ratio", "agree_weight", "disagree_weight", "prob_bot_count"), 6)


def rounded(df, **special: int):
    """Round every double column to nine digits, or as named."""
    digits = {**COARSE, **special}
    return df.select(*[
        F.round(f.name, digits.get(f.name, 9)).alias(f.name) if f.dataType.typeName() == "double" else f.name
        for f in df.schema.fields
    ])


# ------------------------------------------------------------------------------- A: aggregates

FEATURES = ["sentiment_prob", "hate_prob", "offensive_prob", "irony_prob", "rage", "tagged_grok"]
PAIRS = [("sentiment_label", "sentiment_prob"), ("irony_label", "irony_prob"), ("hate_label", "hate_prob"),
         ("offensive_label", "offensive_prob"), ("label", "ai_confidence")]


@query("A1_user_means", sc_sql("""
SELECT commenter_id, """ + ", ".join(
    f"round(avg({'CAST(tagged_grok AS INT)' if f == 'tagged_grok' else f}), 9) AS avg_{f}" for f in FEATURES) + """,
  count(*) AS num_comments FROM sc GROUP BY 1"""))
def _(spark, sf):
    return rounded(users.user_means(scored_comments(spark, sf), FEATURES))


VEC = """
  SELECT label, i - 1 AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS mean, stddev_pop(CAST(embedding[i] AS DOUBLE)) AS std
  FROM embeddings, range(1, 65) r(i) GROUP BY ALL"""


@query("A2_vector_moments", f"""SELECT label, CAST(pos AS INTEGER) AS pos, round(mean, 9) AS mean,
  round(std, 9) AS std FROM ({VEC}) q""")
def _(spark, sf):
    prof = users.vector_profile(table(spark, sf, "embeddings"), "label", "embedding")
    cells = F.arrays_zip(F.col("embedding_mean").alias("mean"), F.col("embedding_std").alias("std"))
    flat = prof.select("label", F.posexplode(cells).alias("pos", "c"))
    return flat.select("label", "pos", r9(F.col("c")["mean"], "mean"), r9(F.col("c")["std"], "std"))


@query("A3_vector_reduced", f"""SELECT label, round(avg(mean), 9) AS embedding_mean_reduced,
  round(avg(std), 9) AS embedding_std_reduced FROM ({VEC}) q GROUP BY 1""")
def _(spark, sf):
    return rounded(users.vector_reduced(table(spark, sf, "embeddings"), "label", "embedding"))


@query("A4_weighted_votes", sc_sql("""
, v AS (""" + " UNION ALL ".join(
    f"SELECT commenter_id, '{lab}' AS col, CAST({lab} AS VARCHAR) AS lab, sum({p}) AS w FROM sc GROUP BY ALL"
    for lab, p in PAIRS) + """),
b AS (SELECT commenter_id, col, lab FROM v QUALIFY row_number() OVER (PARTITION BY commenter_id, col
      ORDER BY round(w, 9) DESC, lab) = 1)
SELECT commenter_id, """ + ", ".join(f"max(lab) FILTER (col = '{lab}') AS {lab}_weighted" for lab, _ in PAIRS) + """
FROM b GROUP BY 1"""))
def _(spark, sf):
    return users.weighted_votes(scored_comments(spark, sf), PAIRS)


@query("A5_group_sizes", sc_sql("""
SELECT commenter_id, count(*) AS num_comments, round(avg(ai_confidence), 9) AS mean_prob FROM sc GROUP BY 1"""))
def _(spark, sf):
    return scored_comments(spark, sf).groupBy("commenter_id").agg(
        F.count("*").alias("num_comments"), r9(F.avg("ai_confidence"), "mean_prob"))


PROFILE = """
  SELECT commenter_id, avg(rbi) AS avg_rbi, stddev_samp(rbi) AS std_rbi, max(rbi) AS max_rbi,
         count(rbi) AS comment_count, avg(label) AS bot_probability, avg(ai_confidence) AS avg_confidence,
         avg(s) AS avg_sentiment, avg(offensive_prob) AS avg_offensive, avg(hate_prob) AS avg_hate,
         avg(rage) AS avg_rage, arg_min(comment_content, comment_id) AS sample_comment FROM x GROUP BY 1"""


@query("A6_user_profiles", sc_sql("""SELECT commenter_id, comment_count, sample_comment, """ + ", ".join(
    f"round({c}, 9) AS {c}" for c in ("avg_rbi", "std_rbi", "max_rbi", "bot_probability", "avg_confidence",
                                      "avg_sentiment", "avg_offensive", "avg_hate", "avg_rage")) + f" FROM ({PROFILE}) q"))
def _(spark, sf):
    return rounded(users.user_profiles(indexed_comments(spark, sf)))


@query("A6_user_table", sc_sql("""
, v AS (""" + " UNION ALL ".join(
    f"SELECT commenter_id, '{lab}' AS col, CAST({lab} AS VARCHAR) AS lab, sum({p}) AS w FROM sc GROUP BY ALL" for lab, p in PAIRS) + """),
b AS (SELECT commenter_id, col, lab FROM v QUALIFY row_number() OVER (PARTITION BY commenter_id, col ORDER BY round(w, 9) DESC, lab) = 1),
w AS (SELECT commenter_id, """ + ", ".join(f"max(lab) FILTER (col = '{lab}') AS {lab}_weighted" for lab, _ in PAIRS) + """ FROM b GROUP BY 1),
m AS (SELECT commenter_id, """ + ", ".join(
    f"avg({'CAST(tagged_grok AS INT)' if f == 'tagged_grok' else f}) AS avg_{f}" for f in FEATURES) + """,
  avg(hate_prob) AS h, avg(irony_prob) AS i, stddev_pop(hate_prob) AS hs, stddev_pop(irony_prob) AS irs, count(*) AS num_comments FROM sc GROUP BY 1)
SELECT commenter_id, """ + ", ".join(f"round(avg_{f}, 9) AS avg_{f}" for f in FEATURES) + """, num_comments,
  """ + ", ".join(f"{lab}_weighted" for lab, _ in PAIRS) + """,
  round((h + i) / 2, 9) AS pair_mean_reduced, round((hs + irs) / 2, 9) AS pair_std_reduced
FROM m JOIN w USING (commenter_id) WHERE num_comments >= 5"""))
def _(spark, sf):
    rows = scored_comments(spark, sf).withColumn("pair", F.array("hate_prob", "irony_prob"))
    return rounded(users.user_table(rows, FEATURES, PAIRS, "pair").where("num_comments >= 5"))


@query("A7_user_stats", sc_sql("""
SELECT commenter_id, round(avg(rbi), 9) AS rbi, round(avg(label), 9) AS label,
       round(avg(ai_confidence), 9) AS ai_confidence, count(comment_id) AS n_comments FROM x GROUP BY 1"""))
def _(spark, sf):
    return rounded(users.user_stats(indexed_comments(spark, sf)))


@query("A8_value_shares", sc_sql("""
SELECT sentiment_label, count(*) AS n, round(count(*) * 1e0 / (SELECT count(*) FROM sc) * 100, 9) AS pct
FROM sc GROUP BY 1"""))
def _(spark, sf):
    return rounded(reports.value_shares(scored_comments(spark, sf), "sentiment_label"))


@query("A9_cross_tab", sc_sql("""
SELECT commenter_id, a AS label_0, b AS label_1, round(a * 1e0 / (a + b), 9) AS share_label_0,
       round(b * 1e0 / (a + b), 9) AS share_label_1
FROM (SELECT commenter_id, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM sc GROUP BY 1) q"""))
def _(spark, sf):
    return rounded(reports.cross_tab(scored_comments(spark, sf), "commenter_id", "label", [0, 1]))


@query("A10_label_shares", sc_sql("""
SELECT commenter_id, count(*) AS comment_count, round(avg(CASE WHEN label = 1 THEN 1 ELSE 0 END), 9) AS share_positive
FROM sc GROUP BY 1 HAVING count(*) > 2"""))
def _(spark, sf):
    return rounded(users.label_shares(scored_comments(spark, sf), "commenter_id", "label", 1))


# Neighbouring comments stand in for users: of every six one moves to the group before, so that groups hold two or four.
PAIR = "(SELECT *, CAST(floor(comment_id / 3e0) AS BIGINT) - CASE WHEN mod(comment_id, 6) = 0 THEN 1 ELSE 0 END AS pair FROM sc)"


def _pairs(spark, sf):
    c = F.col("comment_id")
    moved = F.when(c % 6 == 0, 1).otherwise(0)
    return scored_comments(spark, sf).withColumn("pair", F.floor(c / F.lit(3.0)).cast("bigint") - moved)


@query("A11_pair_agreement", sc_sql(f"""
SELECT count(*) AS users, count(*) FILTER (agrees) AS agreement, count(*) FILTER (NOT agrees) AS disagreement,
       round(coalesce(sum(c) FILTER (agrees), 0), 6) AS agree_weight,
       round(coalesce(sum(c) FILTER (NOT agrees), 0), 6) AS disagree_weight
FROM (SELECT pair, min(label) = max(label) AS agrees, sum(ai_confidence) AS c FROM {PAIR} p
      GROUP BY 1 HAVING count(*) = 2) q"""))
def _(spark, sf):
    return rounded(users.pair_agreement(_pairs(spark, sf), "pair", "label", "ai_confidence"))


@query("A11_weighted_label_shares", sc_sql("""
SELECT commenter_id, count(*) AS comment_count,
       round(sum(CASE WHEN label = 1 THEN ai_confidence ELSE 0e0 END)
             / CASE WHEN sum(ai_confidence) > 0 THEN sum(ai_confidence) ELSE 1e0 END, 9) AS share_positive
FROM sc GROUP BY 1 HAVING count(*) > 2"""))
def _(spark, sf):
    return rounded(users.weighted_label_shares(
        scored_comments(spark, sf), "commenter_id", "label", 1, "ai_confidence"))


def sided(spark, sf):
    return indexed_comments(spark, sf).join(leaning(spark, sf), "author_id")


SIDED = f"{SC}, {LEANING}, y AS (SELECT x.*, l.leaning FROM x JOIN leaning l ON x.author_id = l.author_id)"


@query("A12_leaning_groups", f"""WITH {SIDED}
SELECT leaning, label, round(avg(rbi), 9) AS mean, count(rbi) AS n, round(stddev_samp(rbi), 9) AS std
FROM y GROUP BY ALL""")
def _(spark, sf):
    return rounded(users.leaning_groups(sided(spark, sf), "rbi"))


@query("A12_bot_effect", f"""WITH {SIDED}
SELECT round(l, 9) AS effect_left, round(r, 9) AS effect_right, round(r - l, 9) AS differential FROM (
  SELECT avg(rbi) FILTER (leaning = 'Left' AND label = 1) - avg(rbi) FILTER (leaning = 'Left' AND label = 0) AS l,
         avg(rbi) FILTER (leaning = 'Right' AND label = 1) - avg(rbi) FILTER (leaning = 'Right' AND label = 0) AS r
  FROM y) q""")
def _(spark, sf):
    return rounded(users.bot_effect(sided(spark, sf), "rbi"))


def _variance_sql(var: str, sentiment: str) -> str:
    return f"""
SELECT r.comment_id, r.label, n AS n_replies, round(ev, 9) AS ev FROM x r JOIN (
  SELECT parent_id, count(*) AS n, {var}({sentiment}) + {var}(offensive_prob) AS ev FROM x
  WHERE parent_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2) e ON e.parent_id = r.comment_id
WHERE r.parent_id IS NULL"""


@query("A13_reply_variance_sample", sc_sql(_variance_sql("var_samp", "sentiment_prob")))
def _(spark, sf):
    out = stats.roots_with_variance(indexed_comments(spark, sf), "sentiment_prob", "offensive_prob")
    return out.select("comment_id", "label", "n_replies", r9(F.col("ev"), "ev"))


@query("A13_reply_variance_population", sc_sql(_variance_sql("var_pop", "s")))
def _(spark, sf):
    out = stats.roots_with_variance(indexed_comments(spark, sf), "s", "offensive_prob", population=True)
    return out.select("comment_id", "label", "n_replies", r9(F.col("ev"), "ev"))


@query("A14_dashboard_totals", sc_sql("""
SELECT n AS total_comments, u AS unique_users, h AS hate_comments, o AS offensive_comments, g AS assistant_comments,
       p AS positive, q AS negative, n - p - q AS neutral, round(p * 1e0 / n * 100, 9) AS pct_positive,
       round(q * 1e0 / n * 100, 9) AS pct_negative, round((n - p - q) * 1e0 / n * 100, 9) AS pct_neutral,
       round(h * 1e0 / n * 100, 9) AS pct_hate, round(o * 1e0 / n * 100, 9) AS pct_offensive
FROM (SELECT count(*) AS n, count(DISTINCT commenter_id) AS u, count(*) FILTER (hate_label = 'HATE') AS h,
             count(*) FILTER (offensive_label = 'offensive') AS o,
             count(*) FILTER (tagged_grok OR commenter_id = 'grok') AS g,
             count(*) FILTER (sentiment_label = 'positive') AS p, count(*) FILTER (sentiment_label = 'negative') AS q
      FROM sc WHERE length(commenter_id) BETWEEN 1 AND 50) z"""))
def _(spark, sf):
    return rounded(reports.dashboard_totals(scored_comments(spark, sf)))


@query("A15_dashboard_users", sc_sql("""
SELECT commenter_id, n AS comments, h AS hate_count, o AS offensive_count, g AS negative_count, t AS grok_tags,
       round(sh / n, 9) AS avg_hate, round(so / n, 9) AS avg_offensive, round((h + o) * 1e0 / n, 9) AS toxicity,
       CASE WHEN h > 0 THEN 'FLAGGED' WHEN (h + o) * 1e0 / n > 0.3e0 THEN 'MONITOR' ELSE 'NORMAL' END AS status
FROM (SELECT commenter_id, count(*) AS n, count(*) FILTER (hate_label = 'HATE') AS h,
             count(*) FILTER (offensive_label = 'offensive') AS o,
             count(*) FILTER (sentiment_label = 'negative') AS g, count(*) FILTER (tagged_grok) AS t,
             sum(hate_prob) AS sh, sum(offensive_prob) AS so
      FROM sc WHERE length(commenter_id) BETWEEN 1 AND 30 GROUP BY 1) z"""))
def _(spark, sf):
    return rounded(reports.dashboard_users(scored_comments(spark, sf)))


@query("A16_summary", sc_sql("""
, l AS (SELECT 'rbi' AS "column", rbi AS v FROM x UNION ALL SELECT 'ai_confidence', ai_confidence FROM x
        UNION ALL SELECT 's', s FROM x)
SELECT "column", count(v) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, round(min(v), 9) AS min,
       round(max(v), 9) AS max, round(quantile_cont(v, 0.25), 9) AS p25, round(quantile_cont(v, 0.5), 9) AS p50,
       round(quantile_cont(v, 0.75), 9) AS p75 FROM l GROUP BY 1"""))
def _(spark, sf):
    return rounded(reports.summary(indexed_comments(spark, sf), ["rbi", "ai_confidence", "s"]))


@query("A17_histogram", sc_sql("""
SELECT label, bin, n, round(n / (sum(n) OVER (PARTITION BY label)) / 0.02e0, 9) AS density FROM (
  SELECT label, CAST(least(floor(irony_prob / 1e0 * 50), 49) AS BIGINT) AS bin, count(*) AS n
  FROM sc WHERE irony_prob >= 0 AND irony_prob <= 1 GROUP BY ALL) q"""))
def _(spark, sf):
    return rounded(reports.histogram(scored_comments(spark, sf), "irony_prob", 50, 0.0, 1.0, ["label"]))


@query("A18_box_summary", sc_sql("""
SELECT label, count(*) AS n, """ + ", ".join(
    f"round(quantile_cont(rbi, {p}e0), 9) AS {k}"
    for k, p in (("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1))) + " FROM x GROUP BY 1"))
def _(spark, sf):
    return rounded(reports.box_summary(indexed_comments(spark, sf), "rbi", "label"))


@query("A19_error_by_bin", sc_sql("""
SELECT CAST(floor(ai_confidence * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(abs(ai_confidence - irony_prob)), 9) AS mae
FROM sc WHERE ai_confidence >= 0 AND ai_confidence < 1 GROUP BY 1"""))
def _(spark, sf):
    return rounded(reports.error_by_bin(scored_comments(spark, sf), "ai_confidence", "irony_prob"))


@query("A20_deciles", sc_sql(f"""
, u AS (SELECT avg_rbi AS m, bot_probability AS b FROM ({PROFILE}) q),
e AS (SELECT list_sort(list_distinct(quantile_cont(m, [0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0,
      0.9e0, 1e0]))) AS edges FROM u)
SELECT CAST(greatest(len(list_filter(edges, lambda v: v < m - 1e-12)) - 1, 0) AS BIGINT) AS decile,
       round(avg(b), 9) AS bot_prob_mean, round(stddev_samp(b), 9) AS bot_prob_std, round(avg(m), 9) AS avg_rbi,
       count(*) AS user_count FROM u, e GROUP BY 1"""))
def _(spark, sf):
    profiles = users.user_profiles(indexed_comments(spark, sf)).select("avg_rbi", "bot_probability")
    return rounded(users.deciles(profiles, "avg_rbi", "bot_probability"))


SURE_ROWS = "ai_confidence > 0.9e0 OR ai_confidence < 0.1e0"
TOP = """
, u AS (SELECT commenter_id, avg(rbi) AS rbi, avg(label) AS label, avg(ai_confidence) AS conf FROM x GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY round(rbi, 9) DESC, commenter_id) AS place, count(*) OVER () AS n FROM u),
b AS (SELECT avg(label) * 100 AS base FROM x)"""


@query("A21_enrichment", sc_sql(TOP + """
, g AS (SELECT p, greatest(CAST(floor(n * (p / 100)) AS BIGINT), 1) AS k
        FROM (VALUES (0.1e0), (1e0), (5e0), (10e0), (25e0), (50e0)) t(p), (SELECT max(n) AS n FROM r) z)
SELECT p AS percentile, count(*) AS n_users, round(avg(rbi), 9) AS mean_rbi,
       round(sum(conf) / count(*) * 100, 9) AS prob_bot_pct, round(sum(conf) / count(*) * 100 / max(base), 9) AS prob_enrichment,
       round(count(*) FILTER (label >= 0.5) * 1e0 / count(*) * 100, 9) AS hard_bot_pct,
       round(count(*) FILTER (label >= 0.5) * 1e0 / count(*) * 100 / max(base), 9) AS hard_enrichment,
       round(max(base), 9) AS baseline_pct
FROM r, g, b WHERE place <= k GROUP BY 1"""))
def _(spark, sf):
    return rounded(users.enrichment(indexed_comments(spark, sf)))


@query("A22_super_spreaders", sc_sql(TOP + """
, g AS (SELECT greatest(CAST(floor(max(n) * 0.01e0) AS BIGINT), 10) AS k FROM r)
SELECT max(k) AS n_top_users, round(sum(conf), 6) AS prob_bot_count, round(sum(conf) / max(k) * 100, 9) AS pct_synthetic,
       round(sum(label) / max(k) * 100, 9) AS pct_label, round(sum(label * conf) / max(k) * 100, 9) AS pct_weighted,
       count(*) FILTER (label >= 0.5) AS hard_bot_count,
       round(count(*) FILTER (label >= 0.5) * 1e0 / max(k) * 100, 9) AS hard_pct, round(max(base), 9) AS baseline_pct,
       round(sum(conf) / max(k) * 100 / max(base), 9) AS enrichment
FROM r, g, b WHERE place <= k"""))
def _(spark, sf):
    return rounded(users.super_spreaders(indexed_comments(spark, sf)))


@query("A22_high_confidence", sc_sql(TOP.replace("FROM x", "FROM c").replace("\n, u AS", f"\n, c AS (SELECT * FROM x WHERE {SURE_ROWS})\n, u AS", 1) + """
, g AS (SELECT greatest(CAST(floor(max(n) * 0.01e0) AS BIGINT), 10) AS k FROM r)
SELECT max(k) AS n_top_users, round(sum(conf), 6) AS prob_bot_count, round(sum(conf) / max(k) * 100, 9) AS pct_synthetic,
       round(sum(label) / max(k) * 100, 9) AS pct_label, round(sum(label * conf) / max(k) * 100, 9) AS pct_weighted,
       count(*) FILTER (label >= 0.5) AS hard_bot_count,
       round(count(*) FILTER (label >= 0.5) * 1e0 / max(k) * 100, 9) AS hard_pct, round(max(base), 9) AS baseline_pct,
       round(sum(conf) / max(k) * 100 / max(base), 9) AS enrichment, CAST(NULL AS VARCHAR) AS error
FROM r, g, b WHERE place <= k"""))
def _(spark, sf):
    rows = indexed_comments(spark, sf).where(ix.strictly_confident(F.col("ai_confidence")))
    found = users.super_spreaders(rows).withColumn("error", F.lit(None).cast("string"))
    return rounded(stats.enough_rows(found, rows, 50, "high-confidence data"))


@query("A24_grid_summary", sc_sql("""
, g(t) AS (VALUES (0.05e0), (0.1e0), (0.25e0), (0.5e0)), m(min_comments) AS (VALUES (2), (5), (10)),
w AS (SELECT sc.*, t FROM sc, g WHERE ai_confidence <= t OR ai_confidence >= 1e0 - t),
v AS (SELECT t, commenter_id, label, sum(ai_confidence) AS s FROM w GROUP BY ALL),
b AS (SELECT t, commenter_id, label FROM v QUALIFY row_number() OVER (PARTITION BY t, commenter_id
      ORDER BY round(s, 9) DESC, label) = 1),
c AS (SELECT t, commenter_id, count(*) AS n FROM w GROUP BY ALL)
SELECT min_comments, c.t AS threshold, CAST(sum(n) AS BIGINT) AS rows_kept, count(*) AS users,
       count(*) FILTER (label = 1) AS users_bot, round(count(*) FILTER (label = 1) * 1e0 / count(*) * 100, 9) AS pct_bot
FROM c JOIN b ON c.t = b.t AND c.commenter_id = b.commenter_id JOIN m ON n >= min_comments GROUP BY ALL"""))
def _(spark, sf):
    return rounded(users.grid_summary(scored_comments(spark, sf), (2, 5, 10), (0.05, 0.1, 0.25, 0.5)))


@query("A26_error_rate", sc_sql("SELECT round(avg(1 - ai_confidence), 9) AS error_rate FROM sc"))
def _(spark, sf):
    return scored_comments(spark, sf).agg(r9(F.avg(1 - F.col("ai_confidence")), "error_rate"))


@query("A27_model_agreement", """
SELECT count(*) AS rows, round(avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END), 9) AS agreement,
       count(*) FILTER (quality = toxic AND conf >= 0.8e0) AS confirmed,
       count(*) FILTER (quality = toxic AND conf >= 0.8e0 AND quality = 1) AS confirmed_positive
FROM (SELECT l.*, mod(d.n_chars, 100) / 1e2 AS conf FROM labels l JOIN documents d ON d.doc_id = l.doc_id) q""")
def _(spark, sf):
    sizes = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 100 / F.lit(100.0)).alias("conf"))
    joined = table(spark, sf, "labels").join(sizes, "doc_id")
    return rounded(reports.agreement(joined, "quality", "toxic", "conf"))


# ------------------------------------------------------------------------------- X: statistics

def tests_out(df):
    return rounded(df, u_stat=3)


@query("X1_mann_whitney_one_sided", sc_sql(threshold_sql("rbi", [0.5, 0.7, 0.9], "ai_confidence >= g.threshold")))
def _(spark, sf):
    return tests_out(stats.threshold_tests(indexed_comments(spark, sf)))


@query("X1_mann_whitney_two_sided", sc_sql(threshold_sql(
    "rbi", [0.5, 0.7, 0.9], "ai_confidence >= g.threshold OR ai_confidence <= 1e0 - g.threshold")))
def _(spark, sf):
    return tests_out(stats.threshold_tests(indexed_comments(spark, sf), two_sided=True))


_ONE_SIDED = threshold_sql("rbi", [0.5, 0.7, 0.9], "ai_confidence >= g.threshold")


@query("X1_conclusion", sc_sql(_ONE_SIDED.replace("\nSELECT g.threshold", ", tests AS (\nSELECT g.threshold", 1) + """)
SELECT count(significant) AS tests_run, CASE WHEN count(significant) = 0 THEN 'INSUFFICIENT'
       WHEN bool_and(significant) THEN 'SUPPORTED' ELSE 'PARTIAL/NOT SUPPORTED' END AS conclusion FROM tests"""))
def _(spark, sf):
    return stats.conclusion(stats.threshold_tests(indexed_comments(spark, sf)))


@query("X1_high_confidence", sc_sql(f"""
, w AS (SELECT * FROM x WHERE ai_confidence > 0.9e0 OR ai_confidence < 0.1e0)
SELECT n1, n0, CASE WHEN ok THEN round(mean1, 9) END AS mean1, CASE WHEN ok THEN round(mean0, 9) END AS mean0,
       CASE WHEN ok THEN round(u, 3) END AS u, CASE WHEN ok THEN round(z, 6) END AS z,
       CASE WHEN ok THEN round(delta, 9) END AS delta, CASE WHEN ok THEN round(p_value, 6) END AS p_value,
       CASE WHEN NOT ok THEN 'insufficient samples (bots=' || n1 || ', humans=' || n0 || ')' END AS error
FROM (SELECT *, n1 > 5 AND n0 > 5 AND n1 + n0 >= 50 AS ok FROM ({u_test('w', 'rbi', 'label = 1')}) u) t"""))
def _(spark, sf):
    rows = indexed_comments(spark, sf).where(ix.strictly_confident(F.col("ai_confidence")))
    return rounded(stats.guarded_test(rows, "rbi", F.col("label") == 1, 5, min_rows=50), u=3)


@query("X3_cliffs_delta", sc_sql(f"""
SELECT n1, n0, round(delta, 9) AS delta FROM ({u_test('x', 'rage', 'label = 1')}) t"""))
def _(spark, sf):
    out = stats.rank_statistics(scored_comments(spark, sf), "rage", F.col("label") == 1)
    return out.select("n1", "n0", r9(F.col("delta"), "delta"))


@query("X4_sensitivity", sc_sql(threshold_sql(
    "rage", [0.5, 0.7, 0.9], "ai_confidence >= g.threshold OR ai_confidence <= 1e0 - g.threshold")))
def _(spark, sf):
    return tests_out(stats.threshold_tests(scored_comments(spark, sf), "rage", two_sided=True))


FEATS = ["s", "hate_prob", "offensive_prob", "irony_prob", "rage", "rbi"]


@query("X5_pearson_matrix", sc_sql(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM x"
    for i, a in enumerate(FEATS + ["ai_confidence"]) for b in (FEATS + ["ai_confidence"])[i + 1:])))
def _(spark, sf):
    return rounded(stats.correlation_matrix(indexed_comments(spark, sf), FEATS + ["ai_confidence"]))


PEARSON = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) AS n, corr({f}, ai_confidence) AS r FROM x" for f in FEATS)


@query("X5_strongest_feature", sc_sql(f"""
SELECT arg_max(feature, r) AS strongest, round(max(r), 9) AS strongest_r, arg_max(feature, abs(r)) AS strongest_abs
FROM ({PEARSON}) q"""))
def _(spark, sf):
    t = stats.pearson_table(indexed_comments(spark, sf), FEATS, "ai_confidence")
    return t.agg(F.max_by("feature", "r").alias("strongest"), r9(F.max("r"), "strongest_r"),
                 F.max_by("feature", "abs_r").alias("strongest_abs"))


@query("X6_spearman", sc_sql(" UNION ALL ".join(
    f"""SELECT '{f}' AS feature, count(*) AS n, round(corr(a, b), 9) AS rho FROM (
    SELECT rank() OVER (ORDER BY {f}) + count(*) OVER (PARTITION BY {f}) / 2e0 AS a,
           rank() OVER (ORDER BY ai_confidence) + count(*) OVER (PARTITION BY ai_confidence) / 2e0 AS b FROM x) q"""
    for f in FEATS)))
def _(spark, sf):
    return rounded(stats.spearman_table(indexed_comments(spark, sf), FEATS, "ai_confidence"))


@query("X7_pearson_p", sc_sql(f"""
SELECT feature, n, round(r, 9) AS r, round(abs(r), 9) AS abs_r, round(t, 6) AS t,
       round({f_tail('(t * t)', '1', '(n - 2)')}, 6) AS p_value
FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM ({PEARSON}) q) z"""))
def _(spark, sf):
    return rounded(stats.with_p(stats.pearson_table(indexed_comments(spark, sf), FEATS, "ai_confidence")))


@query("X8_one_way_anova", sc_sql(f"""
, c AS (SELECT author_id, count(*) AS n, avg(rbi) AS m, var_samp(rbi) AS s2 FROM x GROUP BY 1),
t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * m) / sum(n) AS g, sum((n - 1) * s2) AS ssw FROM c),
f AS (SELECT k, nn, ssw, ssb, ssb / (k - 1) / (ssw / (nn - k)) AS f FROM t,
      (SELECT sum(n * (m - g) * (m - g)) AS ssb FROM c, t) z)
SELECT k AS n_groups, CAST(nn AS BIGINT) AS n, round(ssb, 6) AS ss_between, round(ssw, 6) AS ss_within,
       round(f, 6) AS f_stat, round({f_tail('f', '(k - 1)', '(nn - k)')}, 6) AS p_value, CAST(NULL AS VARCHAR) AS error
FROM f"""))
def _(spark, sf):
    t = stats.one_way_anova(indexed_comments(spark, sf), "rbi", "author_id")
    return rounded(stats.anova_p(t, F.col("n_groups") - 1, F.col("n") - F.col("n_groups")))


def _two_way_sql(source: str, value: str, min_rows: int) -> str:
    pick = lambda a, b: f"(leaning = '{a}' AND label = {b})"
    cells = {"11": pick("Left", 0), "12": pick("Left", 1), "21": pick("Right", 0), "22": pick("Right", 1)}
    aggs = ", ".join(f"count({value}) FILTER {w} * 1e0 AS n{k}, avg({value}) FILTER {w} AS m{k}, "
                     f"var_samp({value}) FILTER {w} AS v{k}" for k, w in cells.items())
    main = lambda p, q, r, s: (
        f"pow(n{p}*n{q}/(n{p}+n{q})*(m{p}-m{q}) + n{r}*n{s}/(n{r}+n{s})*(m{r}-m{s}), 2)"
        f" / (n{p}*n{q}/(n{p}+n{q}) + n{r}*n{s}/(n{r}+n{s}))")
    res = " + ".join(f"(n{k} - 1) * v{k}" for k in cells)
    inter = "pow(m11 - m12 - m21 + m22, 2) / (1/n11 + 1/n12 + 1/n21 + 1/n22)"
    return f""", c AS (SELECT {aggs} FROM {source}), q AS (SELECT *, n11+n12+n21+n22 AS n, {res} AS rss FROM c),
f AS (SELECT 'leaning' AS term, n, rss, {main('11', '21', '12', '22')} AS ss FROM q
      UNION ALL SELECT 'label', n, rss, {main('11', '12', '21', '22')} FROM q
      UNION ALL SELECT 'leaning:label', n, rss, {inter} FROM q),
h AS (SELECT *, n >= {min_rows} AND ss IS NOT NULL AS ok, ss / (rss / (n - 4)) AS f FROM f)
SELECT term, CAST(n AS BIGINT) AS n, CASE WHEN ok THEN round(ss, 6) END AS sum_sq,
       CASE WHEN ok THEN round(rss, 6) END AS ss_residual, CASE WHEN ok THEN round(f, 6) END AS f_stat,
       CASE WHEN ok THEN round({f_tail('f', '1', '(n - 4)')}, 6) END AS p_value,
       CASE WHEN NOT ok THEN 'insufficient data' END AS error FROM h"""


INDEX_ROWS, VARIANCE_ROWS = 100, 51  # least rows of the two tests


def _two_way(df, value, min_rows):
    t = stats.two_way_anova(df, value, "leaning", ["Left", "Right"], "label", [0, 1], min_rows=min_rows)
    return rounded(stats.anova_p(t, F.lit(1), F.col("n") - 4))


def confident(df):
    """The strictly high-confidence rows of the suite."""
    return df.where(ix.strictly_confident(F.col("ai_confidence")))


def groups_sql(keep: str, least: int) -> str:
    return f"""WITH {SC}, {LEANING}, y AS (SELECT x.*, lower(l.leaning) || CASE WHEN label = 1 THEN '_bot' ELSE '_human' END AS grp
  FROM x JOIN leaning l ON x.author_id = l.author_id WHERE {keep}),
c AS (SELECT grp, count(*) AS n, avg(rbi) AS m, var_samp(rbi) AS s2 FROM y GROUP BY 1),
t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * m) / sum(n) AS g, sum(coalesce((n - 1) * s2, 0)) AS ssw FROM c),
f AS (SELECT k, nn, ssw, ssb, ssb / (k - 1) / (ssw / (nn - k)) AS f FROM t,
      (SELECT sum(n * (m - g) * (m - g)) AS ssb FROM c, t) z),
q AS (SELECT *, {f_tail('f', '(k - 1)', '(nn - k)')} AS p, nn >= {least} AS ok FROM f)
SELECT CASE WHEN ok THEN k END AS n_groups, CASE WHEN ok THEN CAST(nn AS BIGINT) END AS n, CASE WHEN ok THEN round(ssb, 6) END AS ss_between,
       CASE WHEN ok THEN round(ssw, 6) END AS ss_within, CASE WHEN ok THEN round(f, 6) END AS f_stat, CASE WHEN ok THEN round(p, 6) END AS p_value,
       CASE WHEN ok AND p < 0.05e0 THEN 'INTERACTION FOUND' WHEN ok THEN 'NO SIGNIFICANT INTERACTION' END AS conclusion,
       CASE WHEN NOT ok THEN 'insufficient data after merge (' || CAST(nn AS BIGINT) || ' rows)' END AS error FROM q"""


@query("X8_leaning_groups", groups_sql("true", 100))
def _(spark, sf):
    return rounded(stats.leaning_groups(indexed_comments(spark, sf).join(leaning(spark, sf), "author_id"), "rbi"))


@query("X8_high_confidence", groups_sql(SURE_ROWS, 50))
def _(spark, sf):
    rows = confident(indexed_comments(spark, sf)).join(leaning(spark, sf), "author_id")
    return rounded(stats.leaning_groups(rows, "rbi", min_rows=50))


@query("X9_two_way_anova", f"WITH {SIDED} {_two_way_sql('y', 'rbi', 100)}")
def _(spark, sf):
    return _two_way(sided(spark, sf), "rbi", INDEX_ROWS)


EV = """ev AS (SELECT r.*, e.ev, e.n AS n_replies FROM x r JOIN (
  SELECT parent_id, count(*) AS n, {var}({s}) + {var}(offensive_prob) AS ev FROM x
  WHERE parent_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2) e ON e.parent_id = r.comment_id
  WHERE r.parent_id IS NULL)"""


@query("X9_two_way_anova_on_variance", f"""WITH {SC}, {LEANING}, {EV.format(var='var_pop', s='s')},
y AS (SELECT ev.*, l.leaning FROM ev JOIN leaning l ON ev.author_id = l.author_id) {_two_way_sql('y', 'ev', 51)}""")
def _(spark, sf):
    roots = stats.roots_with_variance(indexed_comments(spark, sf), "s", "offensive_prob", population=True)
    return _two_way(roots.join(leaning(spark, sf), "author_id"), "ev", VARIANCE_ROWS)


@query("X10_trigger_effect", f"""WITH {SC}, {EV.format(var='var_samp', s='sentiment_prob')},
w AS (SELECT * FROM ev WHERE rbi >= (SELECT quantile_cont(rbi, 0.75e0) FROM ev))
SELECT n1, n0, round(mean1, 9) AS mean1, round(mean0, 9) AS mean0, round(u, 3) AS u, round(z, 6) AS z,
       round(delta, 9) AS delta, round(p_value, 6) AS p_value, CAST(NULL AS VARCHAR) AS error
FROM ({u_test('w', 'round(ev, 12)', 'label = 1')}) t""")
def _(spark, sf):
    return rounded(stats.trigger_effect(indexed_comments(spark, sf)), u=3)


@query("X10_high_confidence", f"""WITH {SC}, c AS (SELECT * FROM x WHERE {SURE_ROWS}),
{EV.format(var='var_samp', s='sentiment_prob').replace('FROM x', 'FROM c')},
w AS (SELECT * FROM ev WHERE rbi >= (SELECT quantile_cont(rbi, 0.75e0) FROM ev)),
t AS (SELECT *, m >= 50 AS many, m >= 50 AND n1 > 5 AND n0 > 5 AS ok FROM ({u_test('w', 'round(ev, 12)', 'label = 1')}) u, (SELECT count(*) AS m FROM c) k)
SELECT CASE WHEN many THEN n1 END AS n1, CASE WHEN many THEN n0 END AS n0, CASE WHEN ok THEN round(mean1, 9) END AS mean1,
       CASE WHEN ok THEN round(mean0, 9) END AS mean0, CASE WHEN ok THEN round(u, 3) END AS u, CASE WHEN ok THEN round(z, 6) END AS z,
       CASE WHEN ok THEN round(delta, 9) END AS delta, CASE WHEN ok THEN round(p_value, 6) END AS p_value,
       CASE WHEN NOT many THEN 'insufficient high-confidence data (' || m || ' rows)'
            WHEN NOT ok THEN 'insufficient samples (bots=' || n1 || ', humans=' || n0 || ')' END AS error FROM t""")
def _(spark, sf):
    rows = confident(indexed_comments(spark, sf))
    return rounded(stats.enough_rows(stats.trigger_effect(rows), rows, 50, "high-confidence data"), u=3)


@query("X11_pls_path")
def _(spark, sf):
    roots = stats.roots_with_variance(indexed_comments(spark, sf), "s", "offensive_prob", population=True)
    return rounded(stats.pls_by_label(
        roots, ["s", "offensive_prob", "hate_prob", "rage"], "ev", "label"))


@query("X12_trigger_efficiency", f"""WITH {SC}, {EV.format(var='var_pop', s='s')},
t AS (SELECT avg(ev) FILTER (label = 1) / (avg(rbi) FILTER (label = 1) + 0.001e0) AS b,
             avg(ev) FILTER (label = 0) / (avg(rbi) FILTER (label = 0) + 0.001e0) AS h FROM ev)
SELECT round(b, 6) AS bot_efficiency, round(h, 6) AS human_efficiency, round(b / h, 6) AS ratio FROM t""")
def _(spark, sf):
    roots = stats.roots_with_variance(indexed_comments(spark, sf), "s", "offensive_prob", population=True)
    return rounded(stats.trigger_efficiency(roots))


@query("X13_regression_lines", f"""WITH {SC}, {EV.format(var='var_pop', s='s')}
SELECT label, count(*) AS n, round(regr_slope(ev, rbi), 6) AS slope, round(regr_intercept(ev, rbi), 6) AS intercept
FROM ev GROUP BY 1""")
def _(spark, sf):
    roots = stats.roots_with_variance(indexed_comments(spark, sf), "s", "offensive_prob", population=True)
    return rounded(stats.regression_lines(roots, "ev", "rbi", "label"))


@query("X16_self_consistency", sc_sql(threshold_sql(
    "rbi", [0.6, 0.7, 0.8, 0.9], "ai_confidence >= g.threshold OR ai_confidence <= 1e0 - g.threshold", min_rows=100)))
def _(spark, sf):
    return tests_out(stats.threshold_tests(
        indexed_comments(spark, sf), thresholds=(0.6, 0.7, 0.8, 0.9), two_sided=True, min_rows=100))


@query("X17_retest_confirmed", sc_sql(f"""
, w AS (SELECT * FROM x WHERE label = CASE WHEN irony_prob >= 0.5e0 THEN 1 ELSE 0 END
        AND (ai_confidence >= 0.8e0 OR ai_confidence <= 0.2e0))
SELECT n1, n0, round(mean1, 9) AS mean1, round(mean0, 9) AS mean0, round(u, 3) AS u, round(p_value, 6) AS p_value
FROM ({u_test('w', 'rbi', 'label = 1')}) t"""))
def _(spark, sf):
    second = F.when(F.col("irony_prob") >= 0.5, 1).otherwise(0)
    rows = indexed_comments(spark, sf).where((F.col("label") == second) & ix.confident(F.col("ai_confidence"), 0.2))
    out = stats.rank_statistics(rows, "rbi", F.col("label") == 1)
    return rounded(out.select("n1", "n0", "mean1", "mean0", "u", "p_value"), u=3)


CAL = "(SELECT *, 0.4e0 * rage + 0.3e0 * offensive_prob + 0.3e0 * hate_prob AS cal FROM x)"


@query("X17_retest_calibrated", sc_sql(f"""
, w AS {CAL}
SELECT n1, n0, round(mean1, 9) AS mean1, round(mean0, 9) AS mean0, round(u, 3) AS u, round(p_value, 6) AS p_value,
       (SELECT round(corr(rbi, cal), 9) FROM w) AS correlation
FROM ({u_test('w', 'cal', 'label = 1')}) t"""))
def _(spark, sf):
    cal = ix.calibrated_index(F.col("rage"), F.col("offensive_prob"), F.col("hate_prob"))
    rows = indexed_comments(spark, sf).withColumn("cal", cal)
    out = stats.rank_statistics(rows, "cal", F.col("label") == 1)
    r = rows.agg(F.corr("rbi", "cal")).scalar()
    return rounded(out.select("n1", "n0", "mean1", "mean0", "u", "p_value", r.alias("correlation")), u=3)


@query("X18_dataset_block", sc_sql("""
SELECT count(*) AS comments, count(*) FILTER (label = 1) AS bots, count(*) FILTER (label = 0) AS humans,
       round(count(*) FILTER (label = 1) * 1e0 / count(*) * 100, 9) AS pct_bots,
       round(count(*) FILTER (label = 0) * 1e0 / count(*) * 100, 9) AS pct_humans,
       round(avg(ai_confidence), 9) AS mean_confidence, round(avg(rbi), 9) AS mean_rbi,
       round(stddev_samp(rbi), 9) AS std_rbi FROM x"""))
def _(spark, sf):
    return rounded(reports.dataset_block(indexed_comments(spark, sf)))


# ------------------------------------------------------------------------------- M7-M14: evaluation

PRED = """, p AS (SELECT comment_id, label AS y, (irony_prob + ai_confidence) / 2 AS score FROM sc)"""


def scored_predictions(spark, sf):
    return scored_comments(spark, sf).select(
        "comment_id", F.col("label").alias("y"), ((F.col("irony_prob") + F.col("ai_confidence")) / 2).alias("score"))


@query("M7_threshold_sweep", sc_sql(PRED + """
, g AS (SELECT i, i / 1e2 AS t FROM range(10, 90) r(i)),
c AS (SELECT t, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp,
             count(*) FILTER (score < t AND y = 1) AS fn FROM p, g GROUP BY 1),
f AS (SELECT t, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c)
SELECT coalesce(arg_max(t, f1 * 1e6 - t / 1e4) FILTER (f1 > 0), 0.5e0) AS threshold,
       round(max(f1), 9) AS f1 FROM f"""))
def _(spark, sf):
    return rounded(evaluate.best_threshold(scored_predictions(spark, sf), "y", "score"))


CONF = """, k AS (SELECT count(*) FILTER (score >= 0.5e0 AND y = 1) * 1e0 AS tp, count(*) FILTER (score >= 0.5e0 AND y = 0) * 1e0 AS fp,
  count(*) FILTER (score < 0.5e0 AND y = 1) * 1e0 AS fn, count(*) FILTER (score < 0.5e0 AND y = 0) * 1e0 AS tn FROM p)"""


@query("M8_binary_metrics", sc_sql(PRED + CONF + """
SELECT round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(tp / (tp + fp), 9) AS "precision",
       round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
       round(1 - (tp + tn) / (tp + tn + fp + fn), 9) AS error_rate FROM k"""))
def _(spark, sf):
    pred = evaluate.predicted(scored_predictions(spark, sf), "score", 0.5)
    return rounded(evaluate.binary_metrics(pred, "y", "predicted"))


@query("M9_confusion_matrix", sc_sql(PRED + """
SELECT y, predicted, n, round(n / (sum(n) OVER (PARTITION BY y)) * 100, 9) AS row_pct FROM (
  SELECT y, CASE WHEN score >= 0.5e0 THEN 1 ELSE 0 END AS predicted, count(*) * 1 AS n FROM p GROUP BY ALL) q"""))
def _(spark, sf):
    pred = evaluate.predicted(scored_predictions(spark, sf), "score", 0.5)
    return rounded(evaluate.confusion(pred, "y", "predicted"))


@query("M10_class_report", sc_sql(PRED + CONF + """
, c AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fp + fn) AS f, tn + fp AS s FROM k
  UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM k)
SELECT class, round(p, 9) AS "precision", round(r, 9) AS recall, round(f, 9) AS f1, CAST(s AS BIGINT) AS support FROM c
UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), CAST(sum(s) AS BIGINT) FROM c
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 9), round(sum(r * s) / sum(s), 9),
  round(sum(f * s) / sum(s), 9), CAST(sum(s) AS BIGINT) FROM c"""))
def _(spark, sf):
    pred = evaluate.predicted(scored_predictions(spark, sf), "score", 0.5)
    return rounded(evaluate.class_report(pred, "y", "predicted"))


@query("M11_roc_auc", sc_sql(PRED + f"""
SELECT n1 AS positives, n0 AS negatives, round(u / (n1 * 1e0 * n0), 9) AS auc FROM ({u_test('p', 'score', 'y = 1')}) t"""))
def _(spark, sf):
    return rounded(evaluate.roc_auc(scored_predictions(spark, sf), "y", "score"))


CURVE = """, v AS (SELECT score, count(*) AS n, count(*) FILTER (y = 1) AS k FROM p GROUP BY 1),
c AS (SELECT score, sum(k) OVER w AS tp, sum(n - k) OVER w AS fp, (SELECT sum(k) FROM v) AS pos,
             (SELECT sum(n - k) FROM v) AS neg FROM v WINDOW w AS (ORDER BY score DESC))"""


@query("M11_roc_curve", sc_sql(PRED + CURVE + """
SELECT round(score, 9) AS score, round(fp * 1e0 / neg, 9) AS fpr, round(tp * 1e0 / pos, 9) AS tpr FROM c"""))
def _(spark, sf):
    return rounded(evaluate.roc_curve(scored_predictions(spark, sf), "y", "score"))


@query("M12_pr_curve", sc_sql(PRED + CURVE + """
SELECT round(score, 9) AS score, round(tp * 1e0 / (tp + fp), 9) AS "precision", round(tp * 1e0 / pos, 9) AS recall FROM c"""))
def _(spark, sf):
    return rounded(evaluate.pr_curve(scored_predictions(spark, sf), "y", "score"))


@query("M12_pr_auc", sc_sql(PRED + CURVE + """
, d AS (SELECT score, tp * 1e0 / (tp + fp) AS pr, tp * 1e0 / pos AS re, pos * 1e0 / (pos + neg) AS base FROM c),
e AS (SELECT *, lag(pr, 1, 1e0) OVER (ORDER BY score DESC) AS pr0, lag(re, 1, 0e0) OVER (ORDER BY score DESC) AS re0 FROM d)
SELECT round(sum((re - re0) * (pr + pr0) / 2), 9) AS pr_auc, round(max(base), 9) AS baseline FROM e"""))
def _(spark, sf):
    return rounded(evaluate.pr_auc(scored_predictions(spark, sf), "y", "score"))


@query("M13_regression_metrics", sc_sql("""
SELECT round(avg(pow(ai_confidence - irony_prob, 2)), 9) AS mse, round(sqrt(avg(pow(ai_confidence - irony_prob, 2))), 9) AS rmse,
       round(avg(abs(ai_confidence - irony_prob)), 9) AS mae,
       round(1 - avg(pow(ai_confidence - irony_prob, 2)) / var_pop(ai_confidence), 9) AS r2 FROM sc"""))
def _(spark, sf):
    return rounded(evaluate.regression_metrics(scored_comments(spark, sf), "ai_confidence", "irony_prob"))


@query("M14_prediction_table", sc_sql("""
SELECT comment_id, ai_confidence AS actual, irony_prob AS predicted, round(abs(ai_confidence - irony_prob), 9) AS abs_error,
       CASE WHEN ai_confidence >= 0.5e0 THEN 1 ELSE 0 END AS actual_binary,
       CASE WHEN irony_prob >= 0.5e0 THEN 1 ELSE 0 END AS predicted_binary FROM sc"""))
def _(spark, sf):
    return rounded(evaluate.prediction_table(scored_comments(spark, sf), "comment_id", "ai_confidence", "irony_prob"))

"""Matching, lexicon, vector and labelling queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtide.functions import lookups as lk
from threadtide.operators import labelling, matching, vectors
from threadtide.plans import queries_text, views
from threadtide.plans.registry import query
from threadtide.plans.views import st_sql, table
from threadtide.session import fresh_path


def norm_sql(text: str) -> str:
    out = f"lower({text})"
    for w in lk.BOILERPLATE:
        out = f"replace(replace({out}, '{w}:', ' '), '{w}', ' ')"
    return f"regexp_replace({out}, '[^a-z]', '', 'g')"


def labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


def unlabelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("J10_exact_match", f"""
WITH a AS (SELECT doc_id, {norm_sql('text')} AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
b AS (SELECT {norm_sql('text')} AS n, min(doc_id) AS match_id FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT doc_id, match_id FROM a JOIN b ON a.n = b.n AND a.n <> ''""")
def _(spark, sf):
    return matching.exact_matches(labelled(spark, sf), unlabelled(spark, sf), "doc_id", "text", "doc_id", "text")


# All pairs of long texts are too slow in SQL; tests compare with brute force on a small fixture.
@query("J11_near_match")
def _(spark, sf):
    out = matching.match_texts(labelled(spark, sf), unlabelled(spark, sf), "doc_id", "text", "doc_id", "text")
    return out.withColumn("score", F.round("score", 9))


TURN_ID = "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)"


@query("J11_misspelled_turns", f"""
WITH t AS (SELECT {TURN_ID} AS id, text FROM conversations WHERE role = 'user'),
a AS (SELECT id, {norm_sql("translate(text, 'et', 'xz')")} AS n FROM t),
b AS (SELECT {norm_sql('text')} AS n, min(id) AS match_id FROM t GROUP BY 1),
p AS (SELECT id, match_id, 1 - levenshtein(a.n, b.n) / (greatest(length(a.n), length(b.n)) * 1e0) AS score FROM a JOIN b
      ON a.n <> '' AND b.n <> '' AND length(a.n) >= 0.65e0 * length(b.n) - 1e-9 AND length(b.n) >= 0.65e0 * length(a.n) - 1e-9)
SELECT id, match_id, round(score, 9) AS score FROM p WHERE score >= 0.65e0
QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match_id) = 1""")
def _(spark, sf):
    """What users say, misspelled, against what they said: matches lie between the cut-offs."""
    turns = table(spark, sf, "conversations").where("role = 'user'").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    out = matching.match_texts(turns.withColumn("text", F.translate("text", "et", "xz")), turns, "id", "text", "id", "text")
    return out.select("id", "match_id", F.round("score", 9).alias("score"))


# The documents and three misspelled copies of the benchmark items, to be matched with the benchmark.
MIXED = """mixed AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'a' || CAST(item_id AS VARCHAR), replace(text, 'th', 't') FROM benchmark
  UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), translate(text, 'et', 'xz') FROM benchmark
  UNION ALL SELECT 'c' || CAST(item_id AS VARCHAR), replace(text, '.', '. Fact 7 ') FROM benchmark)"""


def mixed(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    items = table(spark, sf, "benchmark")
    i = F.col("item_id").cast("string")
    copies = F.explode(F.array(
        F.struct(F.concat(F.lit("a"), i).alias("id"), F.replace("text", F.lit("th"), F.lit("t")).alias("text")),
        F.struct(F.concat(F.lit("b"), i).alias("id"), F.translate("text", "et", "xz").alias("text")),
        F.struct(F.concat(F.lit("c"), i).alias("id"), F.replace("text", F.lit("."), F.lit(". Fact 7 ")).alias("text")),
    ))
    return docs.unionByName(items.select(copies.alias("x")).select("x.*"))


BEST = f"""WITH {MIXED},
a AS (SELECT id, {norm_sql('text')} AS n FROM mixed),
b AS (SELECT {norm_sql('text')} AS n, min(item_id) AS match_id FROM benchmark GROUP BY 1),
p AS (SELECT id, match_id, 1 - levenshtein(a.n, b.n) / (greatest(length(a.n), length(b.n)) * 1e0) AS score FROM a JOIN b
      ON a.n <> '' AND b.n <> '' AND length(a.n) >= 0.65e0 * length(b.n) - 1e-9 AND length(b.n) >= 0.65e0 * length(a.n) - 1e-9),
m AS (SELECT id, match_id, score FROM p WHERE score >= 0.65e0
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match_id) = 1),
r AS (SELECT *, CASE WHEN score >= 1 THEN 'exact_alphanum' """ + " ".join(
    f"WHEN score >= {c}e0 THEN 'fuzzy_{c}'" for c in matching.CUTOFFS) + " ELSE 'fuzzy_best' END AS method FROM m)"


@query("J12_match_cascade", BEST + " SELECT id, match_id, round(score, 9) AS score, method FROM r")
def _(spark, sf):
    out = matching.match_texts(mixed(spark, sf), table(spark, sf, "benchmark"), "id", "text", "item_id", "text")
    return out.withColumn("score", F.round("score", 9))


@query("J13_match_report", BEST + """
SELECT coalesce(method, 'unmatched') AS method, count(*) AS n FROM mixed LEFT JOIN r ON mixed.id = r.id GROUP BY 1""")
def _(spark, sf):
    left = mixed(spark, sf)
    found = matching.match_texts(left, table(spark, sf, "benchmark"), "id", "text", "item_id", "text")
    return matching.match_report(left, found, "id")


# ------------------------------------------------------------------------------- J14, V1: lexicon

LEXICON = [("article", t) for t in ("the", "la", "le", "der", "die", "el")] + [
    ("joining", t) for t in ("and", "und", "et", "y", "with")] + [
    ("place", t) for t in ("in", "on", "at", "of", "dans", "en", "von")] + [("negation", t) for t in ("not", "no", "nicht")]
CATEGORIES = ["article", "joining", "place", "negation"]
LEX = "lx(category, term) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in LEXICON) + "), " \
      "tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)"


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "category string, term string")


@query("J14_lexicon_join", f"WITH {LEX} SELECT doc_id, category, count(*) AS hits FROM tk JOIN lx ON tk.term = lx.term GROUP BY ALL")
def _(spark, sf):
    return vectors.lexicon_hits(table(spark, sf, "documents"), "doc_id", "text", lexicon(spark))


@query("V1_lexicon_frequencies", f"WITH {LEX} SELECT d.doc_id, " + ", ".join(
    f"round(coalesce(count(*) FILTER (category = '{c}') * 1e0 / nullif(count(DISTINCT rid), 0), 0), 9) AS {c}" for c in CATEGORIES) + """
FROM documents d LEFT JOIN (SELECT tk.doc_id, category, row_number() OVER () AS rid FROM tk LEFT JOIN lx ON tk.term = lx.term) t
ON d.doc_id = t.doc_id GROUP BY 1""")
def _(spark, sf):
    out = vectors.lexicon_frequencies(table(spark, sf, "documents"), "doc_id", "text", lexicon(spark), CATEGORIES)
    return out.select("doc_id", *[F.round(c, 9).alias(c) for c in CATEGORIES])


TFIDF = r"""WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY ALL),
v AS (SELECT term, ln((1e0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1
      ORDER BY sum(tf) DESC, term LIMIT 5000),
w AS (SELECT doc_id, c.term, tf * idf AS w FROM c JOIN v ON c.term = v.term),
t AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w)"""


@query("V2_tfidf", TFIDF + " SELECT doc_id, term, weight FROM t")
def _(spark, sf):
    out = vectors.tfidf(table(spark, sf, "documents"), "doc_id", "text")
    return out.withColumn("weight", F.round("weight", 9))


@query("V3_truncated_svd")
def _(spark, sf):
    lsa, values = vectors.svd_project(table(spark, sf, "documents"), "doc_id", "text", vectors.lsa_dims(194))
    first = F.element_at("lsa", 1)
    strength = lsa.agg(F.sqrt(F.sum(first * first)).alias("projected"))  # equals the first singular value
    return strength.select("projected", F.lit(values[0]).alias("singular_value"))


@query("V4_concat_vectors", f"""WITH {LEX},
h AS (SELECT doc_id, count(*) FILTER (category = 'article') AS a FROM tk JOIN lx ON tk.term = lx.term GROUP BY 1)
SELECT vec_id, CAST(65 AS BIGINT) AS dims, round(coalesce(a, 0) + list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 5) AS total
FROM embeddings LEFT JOIN h ON vec_id = doc_id""")
def _(spark, sf):
    hits = vectors.lexicon_hits(table(spark, sf, "documents"), "doc_id", "text", lexicon(spark)).where(
        "category = 'article'").select(F.col("doc_id").alias("vec_id"), "hits")
    both = table(spark, sf, "embeddings").join(hits, "vec_id", "left").withColumn(
        "v", vectors.concat_vectors(F.array(F.coalesce("hits", F.lit(0))), F.col("embedding")))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    return both.select("vec_id", F.size("v").cast("bigint").alias("dims"), F.round(total, 5).alias("total"))


def elements(df):
    """Every element of the array ``v`` as a row."""
    return df.select("vec_id", F.posexplode("v").alias("pos", "value")).select("vec_id", "pos", F.round("value", 9).alias("value"))


@query("V5_normalised_embedding", """
WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda u: CAST(u AS DOUBLE) * CAST(u AS DOUBLE)))) AS n FROM embeddings)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN mod(vec_id, 7) = 0 THEN 0e0 ELSE round(CAST(embedding[i] AS DOUBLE) / n, 9) END AS value
FROM e, range(1, 65) r(i)""")
def _(spark, sf):
    raw = F.when(F.col("vec_id") % 7 != 0, F.col("embedding"))  # some texts are empty
    return elements(table(spark, sf, "embeddings").select("vec_id", vectors.normalised(raw, 64).alias("v")))


@query("V5_mean_pool", """
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round((CAST(embedding[i] AS DOUBLE) + CAST(embedding[65 - i] AS DOUBLE)) / 2, 9) AS value
FROM embeddings, range(1, 65) r(i)""")
def _(spark, sf):
    # a text of two tokens: the vector and its mirror image
    pooled = vectors.mean_pool(F.array("embedding", F.reverse("embedding")), 64)
    return elements(table(spark, sf, "embeddings").select("vec_id", pooled.alias("v")))


CENTRES = [[0.01 * i for i in range(64)], [-0.01 * i for i in range(64)]]
DIST = ", ".join(
    f"sqrt(list_sum(list_transform(embedding, lambda v, i: pow(CAST(v AS DOUBLE) - {s}0.01e0 * (i - 1), 2)))) AS d{k}"
    for k, s in enumerate(("", "-")))


@query("V6_centroid_distances", f"SELECT vec_id, round(d0, 9) AS dist_to_centroid_0, round(d1, 9) AS dist_to_centroid_1 FROM (SELECT vec_id, {DIST} FROM embeddings) q")
def _(spark, sf):
    out = vectors.with_distances(table(spark, sf, "embeddings"), "embedding", CENTRES)
    return out.select("vec_id", *[F.round(f"dist_to_centroid_{i}", 9).alias(f"dist_to_centroid_{i}") for i in (0, 1)])


@query("V6_distance_statistics", f"""SELECT round(avg(d0), 9) AS mean_0, round(stddev_pop(d0), 9) AS std_0,
  round(avg(d1), 9) AS mean_1, round(stddev_pop(d1), 9) AS std_1 FROM (SELECT {DIST} FROM embeddings) q""")
def _(spark, sf):
    out = vectors.with_distances(table(spark, sf, "embeddings"), "embedding", CENTRES)
    d = "dist_to_centroid_"
    return out.agg(*[F.round(f(f"{d}{i}"), 9).alias(f"{n}_{i}") for i in (0, 1) for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


@query("V7_standardised", views.sc_sql("""
SELECT comment_id, round((rage - (SELECT avg(rage) FROM sc)) / (SELECT stddev_pop(rage) FROM sc), 9) AS rage,
       round((hate_prob - (SELECT avg(hate_prob) FROM sc)) / (SELECT stddev_pop(hate_prob) FROM sc), 9) AS hate_prob FROM sc"""))
def _(spark, sf):
    df = views.scored_comments(spark, sf).select("comment_id", "rage", "hate_prob")
    out = vectors.standardised(df, ["rage", "hate_prob"])
    return out.select("comment_id", F.round("rage", 9).alias("rage"), F.round("hate_prob", 9).alias("hate_prob"))


@query("V8_pca")
def _(spark, sf):
    out, variance = vectors.pca_project(table(spark, sf, "embeddings"), "embedding", 2)
    return out.select("vec_id", "label", F.element_at("pca", 1).alias("x"), F.element_at("pca", 2).alias("y"),
                      F.lit(variance[0]).alias("explained_0"), F.lit(variance[1]).alias("explained_1"))


# ------------------------------------------------------------------------------- U: labelling

@query("U1_batch_scoring", """
SELECT doc_id, CASE WHEN text LIKE '%the%' THEN 'positive' ELSE 'neutral' END AS sentiment_label,
       round(length(text) / (length(text) + 1e2), 9) AS sentiment_prob FROM documents""")
def _(spark, sf):
    def load():
        import pandas as pd

        def score(texts):
            n = texts.str.len()
            label = texts.str.contains("the", regex=False).map({True: "positive", False: "neutral"})
            return pd.DataFrame({"sentiment_label": label, "sentiment_prob": n / (n + 100.0)})

        return score

    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = labelling.score_batches(docs, "text", load, "sentiment_label string, sentiment_prob double")
    return out.select("doc_id", "sentiment_label", F.round("sentiment_prob", 9).alias("sentiment_prob"))


@query("U1_four_tasks", f"""WITH dummy AS (SELECT 1)
{queries_text.RULES.replace("FROM st)", "FROM (SELECT doc_id, text AS content FROM documents) st)", 1)},
j AS (SELECT rs.*, regexp_matches(content, '(^|\\s)/s\\s*$') AS sarcastic FROM rs JOIN k USING (doc_id))
SELECT DISTINCT doc_id, sentiment AS sentiment_label, sentiment_prob, CASE WHEN sarcastic THEN 'irony' ELSE 'non_irony' END AS irony_label, 0.9e0 AS irony_prob,
       CASE WHEN hate_prob > 0.2e0 THEN 'HATE' ELSE 'NOT-HATE' END AS hate_label,
       round(CASE WHEN hate_prob > 0.2e0 THEN hate_prob ELSE 1 - hate_prob END, 9) AS hate_prob,
       CASE WHEN offensive_prob > 0.2e0 THEN 'offensive' ELSE 'non-offensive' END AS offensive_label,
       round(CASE WHEN offensive_prob > 0.2e0 THEN offensive_prob ELSE 1 - offensive_prob END, 9) AS offensive_prob FROM j""")
def _(spark, sf):
    out = labelling.rule_tasks(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")
    return out.select(*[F.round(c, 9).alias(c) if c.endswith("_prob") else c for c in out.columns])


@query("U2_detection", views.sc_sql("""
SELECT comment_id, CASE WHEN b > a THEN 'LABEL_1' ELSE 'LABEL_0' END AS label, round(exp(b) / (exp(a) + exp(b)), 9) AS ai_confidence
FROM (SELECT comment_id, irony_prob * 4 AS a, hate_prob * 5 AS b FROM sc) q"""))
def _(spark, sf):
    logits = F.array(F.col("irony_prob") * 4, F.col("hate_prob") * 5)
    label, prob = labelling.detection(F.col("l"))
    rows = views.scored_comments(spark, sf).select("comment_id", logits.alias("l"))
    return rows.select("comment_id", label.alias("label"), F.round(prob, 9).alias("ai_confidence"))


def rule_labels(df):
    """Stand-in detector: the rule scorer's machine score at 0.8."""
    from threadtide.functions.text import rule_scores

    scored = rule_scores(df.select("doc_id", F.col("text").alias("content")), "content")
    return scored.select("doc_id", F.when(F.round("ai_prob", 9) >= 0.8, 1).otherwise(0).alias("quality"))


LABELLED = queries_text.RULES.replace("FROM st)", "FROM (SELECT doc_id, text AS content FROM documents) st)", 1)
RULE_LABELS = "CASE WHEN ai_prob >= 0.8e0 THEN 1 ELSE 0 END"


@query("U3_label_remaining", f"""WITH dummy AS (SELECT 1) {LABELLED}
SELECT doc_id, quality FROM labels UNION ALL
SELECT doc_id, {RULE_LABELS} AS quality FROM rs WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return labelling.label_remaining(table(spark, sf, "documents"), labels, "doc_id", "text", rule_labels)


@query("U3_progress", """
SELECT count(*) AS total, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS remaining
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, sf):
    return labelling.labelling_progress(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("U4_propagate_labels", views.sc_sql("""
, p AS (SELECT commenter_id, comment_id, label, row_number() OVER w AS turn,
               count(*) FILTER (label = 1) OVER w AS ones, count(*) FILTER (label = 0) OVER w AS zeros
        FROM sc WHERE length('comment text of some length ' || comment_content) >= 37
        WINDOW w AS (PARTITION BY commenter_id ORDER BY md5('42|' || CAST(comment_id AS VARCHAR)), comment_id)),
v AS (SELECT commenter_id, min(turn) AS decided_after, arg_min(CASE WHEN ones >= 10 THEN 1 ELSE 0 END, turn) AS user_label
      FROM p WHERE turn <= 20 AND (ones >= 10 OR zeros >= 10) GROUP BY 1)
SELECT sc.commenter_id, comment_id, CAST(decided_after AS INTEGER) AS decided_after, user_label FROM sc JOIN v ON sc.commenter_id = v.commenter_id"""))
def _(spark, sf):
    df = views.scored_comments(spark, sf).withColumn(
        "text", F.concat(F.lit("comment text of some length "), "comment_content"))
    return labelling.propagate_user_labels(df, "commenter_id", "comment_id", "text", "label", min_chars=37)


@query("ST2_label_stream", f"""WITH dummy AS (SELECT 1) {LABELLED} SELECT doc_id, {RULE_LABELS} AS quality FROM rs""")
def _(spark, sf):
    from threadtide.streaming import jobs

    source, sink = fresh_path(spark, "unlabelled"), fresh_path(spark, "labelled")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.write.parquet(source)
    rows = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).parquet(source)
    jobs.label_stream(rows, rule_labels, "text", sink, fresh_path(spark, "state"))
    return spark.read.parquet(sink).select("doc_id", "quality")

"""Clustering and model queries; metrics are checked for rows only, except where SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtide.operators import attribution, evaluate, models, vectors
from threadtide.plans.queries_users import FEATURES, PAIRS, rounded
from threadtide.plans.registry import query
from threadtide.plans.views import scored_comments, table
from threadtide.session import fresh_path

NAMES = ["hate_prob", "offensive_prob", "irony_prob", "rage", "noisy"]


def training_rows(spark, sf):
    """Scored comments with one feature that carries the label imperfectly."""
    noisy = F.col("ai_confidence") * 0.6 + F.col("irony_prob") * 0.4
    return scored_comments(spark, sf).select(
        "comment_id", "label", "hate_prob", "offensive_prob", "irony_prob", "rage", noisy.alias("noisy"))


@query("M1_kmeans")
def _(spark, sf):
    out, centres = models.kmeans_best(table(spark, sf, "embeddings"), "embedding", 2, 10)
    placed = vectors.with_distances(out, "embedding", centres)
    d0, d1 = F.col("dist_to_centroid_0"), F.col("dist_to_centroid_1")
    return placed.select("vec_id", "cluster", d0, d1, (F.when(d0 <= d1, 0).otherwise(1) == F.col("cluster")).alias("nearest"))


@query("M1_nearest_centre", "SELECT vec_id, true AS nearest FROM embeddings")
def _(spark, sf):
    out, centres = models.kmeans_best(table(spark, sf, "embeddings"), "embedding", 3, 5)
    far = F.array(*[vectors.distance(F.col("embedding"), c) for c in centres])
    own = F.element_at(far, F.col("cluster") + 1)
    return out.select("vec_id", (own <= F.array_min(far) + 1e-9).alias("nearest"))


@query("M2_cluster_scores", """
WITH e AS (SELECT mod(label, 2) AS y, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS c FROM embeddings),
t AS (SELECT y, c, count(*) * 1e0 AS n FROM e GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY y) a) AS a,
      (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY c) b) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM t) AS al)
SELECT round((ij - a * b / al) / ((a + b) / 2 - a * b / al), 9) AS ari,
       round((SELECT greatest(avg(CASE WHEN y = c THEN 1 ELSE 0 END), avg(CASE WHEN y <> c THEN 1 ELSE 0 END)) FROM e), 9) AS accuracy FROM s""")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select(
        (F.col("label") % 2).alias("y"), F.when(F.element_at("embedding", 1) > 0, 1).otherwise(0).alias("c"))
    return rounded(models.cluster_scores(df, "y", "c"))


@query("M3_clustering_matrix")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") % 2).alias("y"), (F.col("vec_id") % 100 / 99.0).alias("conf"), "embedding",
        F.transform("embedding", lambda x: F.abs(x)).alias("magnitude"), vectors.normalised(F.col("embedding"), 64).alias("unit"))
    return models.clustering_matrix(df, "y", "conf", ["embedding", "magnitude", "unit"],
                                    {"full": None, "conf_0.7": 0.7, "conf_0.9": 0.9})


@query("M4_boosted_trees")
def _(spark, sf):
    _, _, metrics = models.train_classifier(training_rows(spark, sf), NAMES, "label", "comment_id")
    return metrics


@query("M5_better_model")
def _(spark, sf):
    return models.better_of(training_rows(spark, sf), NAMES, "label", "comment_id")


@query("M6_cross_validation")
def _(spark, sf):
    return models.cross_validated(training_rows(spark, sf), NAMES, "label", "comment_id")


@query("M13_confidence_regression")
def _(spark, sf):
    rows = scored_comments(spark, sf).select(
        "comment_id", "ai_confidence", F.array("hate_prob", "irony_prob", "rage", F.col("ai_confidence") * F.col("irony_prob")).alias("v"))
    return models.confidence_regression(rows, "v", "ai_confidence", "comment_id")


def _forest(spark, sf):
    return models.forest_pipeline(NAMES, "label").fit(training_rows(spark, sf))


@query("M15_feature_importance")
def _(spark, sf):
    groups = dict.fromkeys(NAMES[:3], "classifier scores") | {"rage": "lexicon", "noisy": "mixed"}
    return models.importances(_forest(spark, sf), NAMES, spark, groups=groups)


@query("M15_importance_total", "SELECT CAST(5 AS BIGINT) AS features, 1e0 AS total FROM events LIMIT 1")
def _(spark, sf):
    shares = models.importances(_forest(spark, sf), NAMES, spark, groups=dict.fromkeys(NAMES, "all"))
    return shares.agg(F.count("*").alias("features"), F.round(F.sum("importance"), 9).alias("total"))


@query("A23_group_importance")
def _(spark, sf):
    groups = dict.fromkeys(NAMES[:3], "classifier scores") | {"rage": "lexicon", "noisy": "mixed"}
    table_ = models.importances(_forest(spark, sf), NAMES, spark, groups=groups)
    return table_.groupBy("feature_group").agg(F.sum("importance").alias("importance"), F.count("*").alias("features"))


@query("M16_permutation_importance")
def _(spark, sf):
    return models.permutation_importance(_forest(spark, sf), training_rows(spark, sf), NAMES, "label", "comment_id")


@query("M16_attribution_sums", """
SELECT event_id + 1 AS comment_id, true AS adds_up FROM events""")
def _(spark, sf):
    rows = training_rows(spark, sf)
    told = attribution.attributed(_forest(spark, sf), rows, NAMES, "comment_id")
    total = F.col("base")
    for f in NAMES:
        total = total + F.col(f"c_{f}")
    return told.select("comment_id", (F.abs(total - F.col("score")) < 1e-9).alias("adds_up"))


@query("M16_attribution")
def _(spark, sf):
    rows = training_rows(spark, sf)
    told = attribution.attributed(_forest(spark, sf), rows, NAMES, "comment_id")
    return rounded(attribution.attribution_table(told, rows, NAMES, "comment_id"))


@query("M17_user_level_training")
def _(spark, sf):
    # votes weigh by certainty: weighted by P(machine), as the reference does, nearly every user votes 1
    sure = scored_comments(spark, sf).withColumn("sure", F.greatest("ai_confidence", 1 - F.col("ai_confidence")))
    pairs = [(lab, "sure" if lab == "label" else p) for lab, p in PAIRS]
    return models.user_level_training(sure, FEATURES, pairs, (2, 5, 10), (0.05, 0.1, 0.25, 0.5))


@query("M17_single_setting")
def _(spark, sf):
    """All users with at least five comments, whatever the confidence of their labels."""
    sure = scored_comments(spark, sf).withColumn("sure", F.greatest("ai_confidence", 1 - F.col("ai_confidence")))
    pairs = [(lab, "sure" if lab == "label" else p) for lab, p in PAIRS]
    return models.user_level_training(sure, FEATURES, pairs, (5,), (0.5,))


@query("M18_model_round_trip", "SELECT count(*) AS rows, 0e0 AS largest_gap FROM events")
def _(spark, sf):
    path, rows = fresh_path(spark, "model"), training_rows(spark, sf)
    model = _forest(spark, sf)
    models.save(model, path)
    again = models.with_score(models.load(path), rows).select("comment_id", F.col("score").alias("reloaded"))
    both = models.with_score(model, rows).select("comment_id", "score").join(again, "comment_id")
    return both.agg(F.count("*").alias("rows"), F.max(F.abs(F.col("score") - F.col("reloaded"))).alias("largest_gap"))

"""Clustering and supervised models on Spark ML, their evaluation and persistence."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from itertools import product
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadtide.operators import evaluate, lloyd, users, vectors
from threadtide.operators.ranks import global_row_number
from threadtide.operators.sampling import hash_key, stratified_split
from threadtide.operators.stats import rank_statistics
from threadtide.session import cut_lineage

#: Fits that run side by side; each is many short jobs, so a few of them fill what one leaves idle.
FITS = 6
#: Rows of one partition of a table that a fit scans again and again.
FIT_ROWS = 50_000
Made = TypeVar("Made")


# ------------------------------------------------------------------------------- fits side by side

def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], Made]], workers: int = FITS) -> list[Made]:
    """The results of independent driver jobs, ``workers`` at a time, each in a scheduler pool of its own: under the
    FAIR scheduler they share the cluster evenly, under FIFO they still fill each other's gaps. The first error is raised
    after the running jobs have ended."""
    def named(i: int, job: Callable[[], Made]) -> Made:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % workers}")
        return job()

    with ThreadPoolExecutor(min(workers, max(1, len(jobs)))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(named), i, job) for i, job in enumerate(jobs)]
        return [r.result() for r in running]


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """A table kept in memory while fits scan it, in as few partitions as its rows need, and released at the end."""
    rows = df.persist()
    try:
        parts = -(-rows.count() // FIT_ROWS)
        yield rows.coalesce(max(1, parts))
    finally:
        rows.unpersist()


def quantised(df: DataFrame, features: Sequence[str], bins: int = 32) -> DataFrame:
    """The features as bin numbers, cut at the quantiles of all rows in one pass. Trees cut at such borders
    anyway; done once, every fit on the table finds at most ``bins`` values and skips the search."""
    grid = ", ".join(f"{i / bins}D" for i in range(1, bins))
    row = df.agg(*[F.expr(f"percentile_approx(`{f}`, array({grid}), {100 * bins})").alias(f) for f in features]).first()
    borders = [[-float("inf"), *sorted({float(v) for v in row[f] or []}), float("inf")] for f in features]
    cut = Bucketizer(splitsArray=borders, inputCols=list(features), outputCols=[f"_{f}" for f in features], handleInvalid="keep")
    return cut.transform(df).select(
        *[F.col(f"_{c}").alias(c) if c in set(features) else F.col(c) for c in df.columns])


def folded(df: DataFrame, columns: Sequence[str], weight: str = "_weight") -> DataFrame:
    """Rows that are equal in all the columns as one row with their number. Quantised rows fold to as many as there are
    different combinations of bins, however many rows there are."""
    return df.groupBy(*columns).agg(F.count("*").cast("double").alias(weight))


# ------------------------------------------------------------------------------- clustering

def kmeans_best(df: DataFrame, vector: str, k: int = 2, restarts: int = 10, seed: int = 42):
    """M1: the centres of lowest cost over several restarts, which share their scans, and (rows with ``cluster``, centres)."""
    centres, _, _ = lloyd.fit(df, vector, k, restarts, seed)
    x = F.transform(vector, lambda v: v.cast("double"))
    far = F.array(*[vectors.distance(F.col(vector), [float(v) for v in c]) for c in centres])
    placed = df.withColumns({"_v": array_to_vector(x), "_far": far})
    cluster = (F.array_position("_far", F.array_min("_far")) - 1).cast("int")
    return placed.withColumn("cluster", cluster).drop("_far"), [[float(v) for v in c] for c in centres]


def aligned(df: DataFrame, y: str, cluster: str, name: str = "aligned") -> DataFrame:
    """M2: a two-cluster labelling, swapped when more rows disagree than agree."""
    swap = df.agg(F.count_if(F.col(y) != F.col(cluster)) > F.count_if(F.col(y) == F.col(cluster))).scalar()
    return df.withColumn(name, F.when(swap, 1 - F.col(cluster)).otherwise(F.col(cluster)))


def adjusted_rand(df: DataFrame, y: str, cluster: str) -> DataFrame:
    """M2: adjusted Rand index from the contingency table."""
    def pairs(n: Column) -> Column:
        return n.cast("double") * (n - 1) / 2

    cells = df.groupBy(F.col(y).alias("_y"), F.col(cluster).alias("_c")).agg(F.count("*").alias("n"))
    sums = cells.groupingSets([["_y", "_c"], ["_y"], ["_c"], []], "_y", "_c").agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n"))
    row = sums.agg(
        F.sum(F.when(F.col("g") == 0, pairs(F.col("n")))).alias("ij"),
        F.sum(F.when(F.col("g") == 1, pairs(F.col("n")))).alias("a"),
        F.sum(F.when(F.col("g") == 2, pairs(F.col("n")))).alias("b"),
        F.max(F.when(F.col("g") == 3, pairs(F.col("n")))).alias("all"),
    )
    expected = F.col("a") * F.col("b") / F.col("all")
    top = (F.col("a") + F.col("b")) / 2
    return row.select(
        F.when(top == expected, F.lit(1.0)).otherwise((F.col("ij") - expected) / (top - expected)).alias("ari"))


def cluster_scores(df: DataFrame, y: str, cluster: str) -> DataFrame:
    """M2: adjusted Rand index and, after alignment, accuracy."""
    hits = aligned(df, y, cluster)
    accuracy = hits.agg(F.avg((F.col(y) == F.col("aligned")).cast("int"))).scalar()
    return adjusted_rand(df, y, cluster).withColumn("accuracy", accuracy)


def silhouette(df: DataFrame, vector_col: str, cluster: str) -> float:
    """M2: silhouette with squared Euclidean distances, which needs only the cluster moments."""
    return ClusteringEvaluator(featuresCol=vector_col, predictionCol=cluster).evaluate(df)


def clustering_matrix(df: DataFrame, y: str, conf: str, vectors: Sequence[str], cuts: dict[str, float | None],
                      restarts: int = 10) -> DataFrame:
    """M3: scores of every data set (a two-sided confidence cut or none) and vector column, clustered side by side."""
    def one(name: str, cut: float | None, v: str) -> DataFrame:
        rows = df if cut is None else df.where((F.col(conf) >= cut) | (F.col(conf) <= 1 - cut))
        clustered = cut_lineage(kmeans_best(rows.select(y, v), v, 2, restarts)[0])
        return cluster_scores(clustered, y, "cluster").select(
            F.lit(name).alias("dataset"), F.lit(v).alias("vector"), "ari", "accuracy",
            F.lit(float(silhouette(clustered, "_v", "cluster"))).alias("silhouette"))

    cells = [lambda n=n, c=c, v=v: one(n, c, v) for n, c in cuts.items() for v in vectors]
    return reduce(DataFrame.unionByName, side_by_side(df.sparkSession, cells))


# ------------------------------------------------------------------------------- classifiers

def assembled(features: Sequence[str]) -> list:
    return [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]


def gbt_pipeline(features: Sequence[str], label: str, rounds: int = 200, depth: int = 6, rate: float = 0.05,
                 validation: str | None = None, seed: int = 42, weight: str | None = None) -> Pipeline:
    """M4: standardised features and boosted trees, stopped early on the validation rows when marked."""
    gbt = GBTClassifier(labelCol=label, featuresCol="features", stepSize=rate, maxDepth=depth, maxIter=rounds,
                        subsamplingRate=0.8, minInstancesPerNode=3, seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(stages=[*assembled(features), gbt])


def forest_pipeline(features: Sequence[str], label: str, trees: int = 100, depth: int = 6, seed: int = 42,
                    weight: str | None = None) -> Pipeline:
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*assembled(features), forest.setWeightCol(weight) if weight else forest])


def with_score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with the probability of the positive class as ``score``."""
    return model.transform(df).withColumn("score", F.element_at(vector_to_array("probability"), 2))


def test_metrics(scored: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, error rate and AUC of scored rows."""
    pred = evaluate.predicted(scored, "score", threshold)
    auc = evaluate.roc_auc(scored, label, "score").select("auc").scalar()
    return evaluate.binary_metrics(pred, label, "predicted").withColumn("auc", auc)


def train_classifier(df: DataFrame, features: Sequence[str], label: str, key: str, rounds: int = 200, depth: int = 6):
    """M4: 60/20/20 split, early stopping on the validation part, threshold chosen there, test metrics.

    Returns (model, threshold, metrics). The parts are disjoint by hash.
    """
    parts = cut_lineage(stratified_split(df, label, key, {"train": 0.6, "val": 0.2, "test": 0.2}).withColumn(
        "_val", F.col("part") == "val"))
    with held(parts.where("part <> 'test'")) as rows:
        model = gbt_pipeline(features, label, rounds, depth, validation="_val").fit(rows)
    threshold = float(evaluate.best_threshold(with_score(model, parts.where("part = 'val'")), label, "score")
                      .first()["threshold"])
    metrics = test_metrics(with_score(model, parts.where("part = 'test'")), label, threshold)
    return model, threshold, metrics.withColumn("threshold", F.lit(threshold))


def better_of(df: DataFrame, features: Sequence[str], label: str, key: str, rounds: int = 100, trees: int = 100,
              depth: int = 6) -> DataFrame:
    """M5: random forest against boosted trees on the same split, fitted side by side; ``kept`` marks the better accuracy.

    The fits scan the training rows folded by their bins, with the number of rows as weight.
    """
    split = stratified_split(df, label, key, {"train": 0.8, "test": 0.2}).select("part", label, *features)
    parts = cut_lineage(quantised(cut_lineage(split).na.drop(subset=list(features)), features))
    pipes = {"gbt": gbt_pipeline(features, label, rounds, depth, weight="_weight"),
             "forest": forest_pipeline(features, label, trees, depth, weight="_weight")}
    with held(folded(parts.where("part = 'train'"), [label, *features])) as train:
        def one(name: str) -> DataFrame:
            scored = with_score(pipes[name].fit(train), parts.where("part = 'test'"))
            return cut_lineage(test_metrics(scored, label).withColumn("model", F.lit(name)))

        made = side_by_side(df.sparkSession, [lambda n=n: one(n) for n in pipes])
    out = made[0].unionByName(made[1])
    best = out.agg(F.max_by("model", F.struct("accuracy", "model"))).scalar()
    return out.withColumn("kept", F.col("model") == best)


def cross_validated(df: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 5,
                    rounds: int = 100, depth: int = 6) -> DataFrame:
    """M6: mean and population deviation of the accuracy over hash folds, fitted side by side on one table.

    A fit scans its rows folded by their bins, with the number of rows as weight; the accuracy is that of single rows.
    """
    lead = F.conv(F.substring(hash_key(key), 1, 8), 16, 10).cast("bigint")
    kept = df.na.drop(subset=list(features)).select(F.pmod(lead, F.lit(folds)).alias("_fold"), label, *features)
    rows = cut_lineage(quantised(cut_lineage(kept), features))

    def one(i: int) -> DataFrame:
        with held(folded(rows.where(F.col("_fold") != i), [label, *features])) as train:
            model = gbt_pipeline(features, label, rounds, depth, weight="_weight").fit(train)
        pred = evaluate.predicted(with_score(model, rows.where(F.col("_fold") == i)), "score", 0.5)
        return cut_lineage(evaluate.binary_metrics(pred, label, "predicted").select("accuracy"))

    out = None
    for made in side_by_side(df.sparkSession, [lambda i=i: one(i) for i in range(folds)]):
        out = made if out is None else out.unionByName(made)
    return out.agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"),
                   F.count("*").alias("folds"))


def confidence_regression(df: DataFrame, vector: str, target: str, key: str) -> DataFrame:
    """Linear regression of a confidence on a vector; error metrics and metrics at 0.5 on the test part."""
    rows = df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).withColumn(
        "_one", F.lit(1))
    parts = cut_lineage(stratified_split(rows, "_one", key, {"train": 0.8, "test": 0.2}))
    model = LinearRegression(labelCol=target, featuresCol="features").fit(parts.where("part = 'train'"))
    out = model.transform(parts.where("part = 'test'")).select(
        F.col(target).alias("actual"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))
    errors = evaluate.regression_metrics(out, "actual", "score")
    binary = evaluate.predicted(evaluate.predicted(out, "actual", 0.5, "y"), "score", 0.5)
    accuracy = evaluate.binary_metrics(binary, "y", "predicted").select("accuracy").scalar()
    auc = evaluate.roc_auc(binary, "y", "score").select("auc").scalar()
    return errors.withColumns({"accuracy": accuracy, "auc": auc})


def importances(model: PipelineModel, features: Sequence[str], spark, n: int = 20,
                groups: dict[str, str] | None = None) -> DataFrame:
    """The n most important features by impurity gain."""
    return evaluate.top_importances(spark, features, model.stages[-1].featureImportances.toArray(), groups, n)


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    """AUC lost when a feature is permuted, and the direction of its effect.

    Rows are numbered once in random order; each row borrows the features of the next row. One pass
    scores every row once per feature with that feature borrowed, and is written as the rows per score.
    """
    numbered = global_row_number(df.select(key, label, *features), [hash_key(key), F.col(key)], "_r")
    donors = numbered.select(
        (F.col("_r") % F.col("_r_total") + 1).alias("_r"), F.struct(*features).alias("_d"))
    rows = numbered.join(donors, "_r").withColumn("permuted", F.explode(F.array(
        F.lit("none"), *[F.lit(f) for f in features])))
    swapped = rows.withColumns({
        f: F.when(F.col("permuted") == f, F.col("_d")[f]).otherwise(F.col(f)) for f in features})
    scored = with_score(model, swapped.select(key, label, "permuted", *features))
    counts = cut_lineage(scored.groupBy("permuted", label, "score").agg(F.count("*").alias("_n")))
    aucs = cut_lineage(rank_statistics(counts, "score", F.col(label) == 1, ["permuted"], F.col("_n")).select(
        "permuted", ((F.col("delta") + 1) / 2).alias("auc")))
    base = aucs.where("permuted = 'none'").select("auc").scalar()
    plain = with_score(model, df).agg(*[F.corr(f, "score").alias(f) for f in features])
    signs = plain.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])).alias("x")).select("x.*")
    return aucs.where("permuted <> 'none'").select(
        F.col("permuted").alias("feature"), (base - F.col("auc")).alias("auc_drop")
    ).join(signs, "feature").select(
        "feature", "auc_drop", "r", F.when(F.col("r") >= 0, "raises").otherwise("lowers").alias("direction"))


def user_table(df: DataFrame, features: Sequence[str], pairs, thresholds: Sequence[float], bins: int = 32) -> tuple[DataFrame, list[str]]:
    """The users of every threshold from one pass over the comments, with quantised features and the voted label
    ``y``, written once for all fits; and the names of the features."""
    rows = users.grid_rows(df, thresholds)
    table = users.user_means(rows, features, by=["threshold"]).join(
        users.weighted_votes(rows, pairs, by=["threshold"]), ["threshold", "commenter_id"]).withColumn(
        "y", F.col("label_weighted").cast("int"))
    names = [f"avg_{f}" for f in features] + ["num_comments"]
    kept = cut_lineage(table.select("threshold", "commenter_id", "y", F.col("num_comments").alias("_n"), *names))
    return cut_lineage(quantised(kept, names, bins)), names


def user_level_training(df: DataFrame, features: Sequence[str], pairs, min_comments: Sequence[int],
                        thresholds: Sequence[float], rounds: int = 100, depth: int = 6) -> DataFrame:
    """For every cell of the grid a model of the users' voted label and its test metrics.

    A cell is a filter on one prepared table; cells are fitted side by side. Cells without both classes in their training
    part are left out.
    """
    table, names = user_table(df, features, pairs, thresholds)

    def one(m: int, t: float) -> DataFrame | None:
        cell = table.where((F.col("threshold") == t) & (F.col("_n") >= m))
        split = cut_lineage(stratified_split(cell, "y", "commenter_id", {"train": 0.8, "test": 0.2}))
        train = split.where("part = 'train'")
        if train.agg(F.countDistinct("y")).first()[0] < 2:
            return None
        with held(train) as rows:
            model = gbt_pipeline(names, "y", rounds, depth).fit(rows)
        return cut_lineage(test_metrics(with_score(model, split.where("part = 'test'")), "y").withColumns(
            {"min_comments": F.lit(m), "threshold": F.lit(float(t))}))

    cells = [lambda m=m, t=t: one(m, t) for m, t in product(min_comments, thresholds)]
    made = [x for x in side_by_side(df.sparkSession, cells) if x is not None]
    if not made:
        raise ValueError("no cell of the grid holds both classes")
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return out


def save(model: PipelineModel, path: str) -> None:
    """The fitted pipeline with its scaler."""
    model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)

"""Evaluation of scores and predictions, each from one aggregation or one ordered pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtide.operators.ranks import ordered_counts
from threadtide.operators.stats import rank_statistics


def predicted(df: DataFrame, score: str, threshold: float, name: str = "predicted") -> DataFrame:
    """P20: binary prediction of a score."""
    return df.withColumn(name, F.when(F.col(score) >= threshold, 1).otherwise(0))


def best_threshold(df: DataFrame, y: str, score: str, start: int = 10, stop: int = 90) -> DataFrame:
    """M7: threshold in hundredths with the first maximal F1, 0.5 when every F1 is 0.

    Scores fold to the number of thresholds they reach (at most 81 cells); the sweep runs on those.
    """
    hundredths = F.floor(F.col(score) * 100)  # a rounding step may put it one too low or too high
    exact = (
        F.when((hundredths + 1) / 100.0 <= F.col(score), hundredths + 1)
        .when(hundredths / 100.0 > F.col(score), hundredths - 1).otherwise(hundredths)
    )
    reached = F.least(F.greatest(exact - start + 1, F.lit(0)), F.lit(stop - start)).cast("int")
    cells = df.groupBy(reached.alias("c")).agg(
        F.count_if(F.col(y) == 1).alias("k"), F.count_if(F.col(y) == 0).alias("m")
    )
    places = df.sparkSession.range(start, stop).select(
        (F.col("id") / F.lit(100.0)).alias("t"), (F.col("id") - start + 1).cast("int").alias("need")
    )
    hit = F.col("c") >= F.col("need")
    sums = places.join(cells.withColumn("_all", F.lit(1)), F.col("_all") == 1).groupBy("t").agg(
        F.sum(F.when(hit, F.col("k")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("m")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("k")).otherwise(0)).alias("fn"),
    )
    denominator = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.round(F.when(denominator > 0, 2.0 * F.col("tp") / denominator).otherwise(F.lit(0.0)), 9)
    best = F.min(F.when(F.col("f1") > 0, F.struct((-F.col("f1")).alias("a"), F.col("t"))))
    return sums.select("t", f1.alias("f1")).agg(
        F.coalesce(best["t"], F.lit(0.5)).alias("threshold"), F.max("f1").alias("f1")
    )


def _cells(y: str, p: str) -> dict[str, Column]:
    return {
        "tp": F.count_if((F.col(y) == 1) & (F.col(p) == 1)),
        "fp": F.count_if((F.col(y) == 0) & (F.col(p) == 1)),
        "fn": F.count_if((F.col(y) == 1) & (F.col(p) == 0)),
        "tn": F.count_if((F.col(y) == 0) & (F.col(p) == 0)),
    }


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """M8: accuracy, precision, recall, F1 and error rate; without rows accuracy and error rate are NULL."""
    row = df.agg(*[c.alias(k) for k, c in _cells(y, p).items()])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    accuracy = F.try_divide(tp + tn, tp + tn + fp + fn)
    return row.select(
        accuracy.alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (1 - accuracy).alias("error_rate"),
    )


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """M9: counts and row percentages."""
    rows = Window.partitionBy(y)  # one row per predicted class
    return df.groupBy(y, p).agg(F.count("*").alias("n")).withColumn(
        "row_pct", F.col("n") / F.sum("n").over(rows) * 100
    )


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted averages."""
    cells = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
                 F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("hit"),
                 F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed")),
    )).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(
        F.sum("hit").alias("hit"), F.sum("actual").alias("support"), F.sum("guessed").alias("guessed")
    ).select(
        F.col("c").cast("string").alias("class"),
        _ratio(F.col("hit"), F.col("guessed")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("support") + F.col("guessed")).alias("f1"),
        "support",
    )
    names = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    return (
        per.unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve, U / (n1 n0); NULL where a class is absent."""
    t = rank_statistics(df, score, F.col(y) == 1)
    return t.select(
        F.col("n1").alias("positives"), F.col("n0").alias("negatives"),
        F.try_divide("u", F.col("n1").cast("double") * F.col("n0")).alias("auc"),
    )


def _curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """Per distinct score: positives and negatives at or above it."""
    counts = ordered_counts(df, score, (), {"k": (F.col(y) == 1).cast("bigint")})
    tp = F.col("k_total") - F.col("k_before")
    rows = F.col("n_total") - F.col("n_before")
    return counts.select(
        F.col(score).alias("score"), tp.alias("tp"), (rows - tp).alias("fp"), "n", "k",
        F.col("k_total").alias("pos"), (F.col("n_total") - F.col("k_total")).alias("neg"),
    )


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """False and true positive rate at every distinct score."""
    return _curve(df, y, score).select(
        "score", (F.col("fp") / F.col("neg")).alias("fpr"), (F.col("tp") / F.col("pos")).alias("tpr")
    )


def pr_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """Precision and recall at every distinct score."""
    return _curve(df, y, score).select(
        "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("pos")).alias("recall"),
    )


def pr_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Trapezoid area under the PR curve. The next higher score's point needs no lag: its counts
    are this point's counts less the rows of this score."""
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("k"), fp - (F.col("n") - F.col("k"))
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    step = (tp - tp0) / F.col("pos")
    area = F.sum(step * (tp / (tp + fp) + before) / 2)
    return _curve(df, y, score).agg(
        area.alias("pr_auc"), F.max(F.col("pos") / (F.col("pos") + F.col("neg"))).alias("baseline")
    )


def regression_metrics(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """MSE, RMSE, MAE and R2."""
    e = F.col(actual) - F.col(pred)
    mse = F.avg(e * e)
    return df.agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - mse / F.var_pop(actual)).alias("r2"),
    )


def prediction_table(df: DataFrame, key: str, actual: str, pred: str) -> DataFrame:
    """Actual, predicted, absolute error and both at 0.5."""
    return df.select(
        key, F.col(actual).alias("actual"), F.col(pred).alias("predicted"),
        F.abs(F.col(actual) - F.col(pred)).alias("abs_error"),
        F.when(F.col(actual) >= 0.5, 1).otherwise(0).alias("actual_binary"),
        F.when(F.col(pred) >= 0.5, 1).otherwise(0).alias("predicted_binary"),
    )


def top_importances(spark, names: Sequence[str], values: Sequence[float], groups: dict[str, str] | None = None,
                    n: int = 20) -> DataFrame:
    """The n features with largest importance, with their feature group."""
    rows = [(f, (groups or {}).get(f, "other"), float(v)) for f, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, feature_group string, importance double").orderBy(
        F.desc("importance"), "feature"
    ).limit(n)

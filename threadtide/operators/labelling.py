"""Batch scoring through a pluggable scorer, resumable labelling and user-wide label propagation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtide.functions.text import rule_scores
from threadtide.operators.sampling import hash_key, per_user_sample

BatchScorer = Callable[[pd.Series], pd.DataFrame]


def score_batches(df: DataFrame, text: str, load: Callable[[], BatchScorer], schema: str) -> DataFrame:
    """Add the scorer's columns. ``load`` runs once per task, e.g. to open a model; the scorer maps
    a batch of texts to a frame of results. Rows whose text is NULL get NULL results, as does a row that the
    scorer fails on: a failing batch is halved until the row stands alone."""
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(schema)
    whole = StructType(df.schema.fields + extra.fields)
    names = [f.name for f in extra.fields]

    def scored(scorer: BatchScorer, texts: pd.Series) -> pd.DataFrame:
        try:
            return scorer(texts)
        except Exception:
            if len(texts) < 2:
                return pd.DataFrame(index=texts.index, columns=names)
            half = len(texts) // 2
            return pd.concat([scored(scorer, texts.iloc[:half]), scored(scorer, texts.iloc[half:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            known = batch[text].notna()
            found = scored(scorer, batch.loc[known, text])
            for n in names:
                batch[n] = pd.Series(found[n].values, index=batch.index[known]).reindex(batch.index)
            yield batch

    return df.mapInPandas(run, whole)


#: The tasks of the batch analysis and the labels of each, first the one of a positive finding.
TASKS = {"sentiment": ("negative", "positive", "neutral"), "irony": ("irony", "non_irony"),
         "hate": ("HATE", "NOT-HATE"), "offensive": ("offensive", "non-offensive")}


def score_tasks(df: DataFrame, text: str, load: dict[str, Callable[[], BatchScorer]]) -> DataFrame:
    """``<task>_label`` and ``<task>_prob`` of every task, each from a scorer of its own that maps texts to a frame
    (label, prob). Models are opened once per task of Spark; a text that one scorer fails on is NULL in all columns."""
    def opened() -> BatchScorer:
        scorers = {name: one() for name, one in load.items()}

        def score(texts: pd.Series) -> pd.DataFrame:
            parts = [s(texts).set_axis([f"{n}_label", f"{n}_prob"], axis=1) for n, s in scorers.items()]
            return pd.concat([p.reset_index(drop=True) for p in parts], axis=1)

        return score

    return score_batches(df, text, opened, ", ".join(f"{n}_label string, {n}_prob double" for n in load))


def rule_tasks(df: DataFrame, text: str) -> DataFrame:
    """The four tasks by the rule scorer, for use without models; all in expressions. The probability is that of the
    label; a text that ends in the sarcasm mark ``/s`` is ironic. NULL texts have NULL results."""
    scored = rule_scores(df.withColumn("_text", F.col(text)), "_text")
    known = F.col(text).isNotNull()
    sarcastic = F.col(text).rlike(r"(^|\s)/s\s*$")

    def two(task: str, hit: Column, prob: Column) -> dict[str, Column]:
        yes, no = TASKS[task]
        return {f"{task}_label": F.when(known, F.when(hit, yes).otherwise(no)), f"{task}_prob": F.when(known, F.when(hit, prob).otherwise(1 - prob))}

    columns = {"sentiment_label": F.when(known, F.col("sentiment")), "sentiment_prob": F.when(known, F.col("sentiment_prob"))}
    columns |= two("irony", sarcastic, F.when(sarcastic, 0.9).otherwise(0.1))
    columns |= two("hate", F.col("hate_prob") > 0.2, F.col("hate_prob")) | two("offensive", F.col("offensive_prob") > 0.2, F.col("offensive_prob"))
    return scored.select(*df.columns, *[c.alias(k) for k, c in columns.items()])


def probabilities(logits: Column) -> Column:
    """Softmax of an array of logits, shifted by the maximum."""
    shifted = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(shifted, lambda v: v / total)


def detection(logits: Column) -> tuple[Column, Column]:
    """Predicted label LABEL_k (first maximum) and the probability of the positive class."""
    best = F.array_position(logits, F.array_max(logits)) - 1
    return F.concat(F.lit("LABEL_"), best.cast("string")), F.element_at(probabilities(logits), 2)


def unlabelled(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows that have no label yet."""
    return df.join(labels.select(key), key, "left_anti")


def label_remaining(df: DataFrame, labels: DataFrame, key: str, text: str,
                    score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Earlier labels kept as they are, plus labels for rows that have none and are not blank."""
    todo = unlabelled(df, labels, key).where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
    return labels.unionByName(score(todo).select(*labels.columns))


def labelling_progress(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Total, labelled and remaining rows."""
    joined = df.select(key).join(labels.select(key).withColumn("_l", F.lit(1)), key, "left")
    return joined.agg(
        F.count("*").alias("total"),
        F.count("_l").alias("labelled"),
        (F.count("*") - F.count("_l")).alias("remaining"),
    )


def propagate_user_labels(df: DataFrame, user: str, key: str, text: str, label: str,
                          sample: int = 20, agree: int = 10, min_chars: int = 40, seed: int = 42) -> DataFrame:
    """U4: decide a user's label once ``agree`` of at most ``sample`` random eligible posts agree, and give
    it to all of the user's remaining posts. ``label`` holds what the detector says for a sampled post.

    Only the sample (at most ``sample`` rows per user) meets in a window; the decision is joined back.
    """
    eligible = df.where(F.length(text) >= min_chars).select(user, key, label)
    picked = per_user_sample(eligible, user, key, sample, seed)
    order = [hash_key(key, seed), F.col(key)]
    seen = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        picked.withColumn("_turn", F.row_number().over(Window.partitionBy(user).orderBy(*order)))
        .withColumn("_ones", F.count_if(F.col(label) == 1).over(seen))
        .withColumn("_zeros", F.count_if(F.col(label) == 0).over(seen))
    )
    reached = counted.where((F.col("_ones") >= agree) | (F.col("_zeros") >= agree))
    verdict = reached.groupBy(user).agg(
        F.min("_turn").alias("decided_after"),
        F.min_by(F.when(F.col("_ones") >= agree, 1).otherwise(0), "_turn").alias("user_label"),
    )
    return df.select(user, key).join(verdict, user)

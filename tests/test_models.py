"""The registered model queries run with the operators' own restarts, rounds, trees and depths."""

import inspect

import pytest
from pyspark.sql import functions as F

from threadtide.operators import models, stats
from threadtide.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, operator", [
    ("M3_clustering_matrix", "clustering_matrix"), ("M4_boosted_trees", "train_classifier"), ("M5_better_model", "better_of"),
    ("M6_cross_validation", "cross_validated"), ("M17_user_level_training", "user_level_training")])
def test_registered_fits_are_whole(spark, monkeypatch, name, operator):
    signature = inspect.signature(getattr(models, operator))
    calls = []

    def record(*args, **kwargs):
        calls.append(signature.bind(*args, **kwargs).arguments)
        return None, None, None

    monkeypatch.setattr(models, operator, record)
    catalog.ENTRIES[name].build(spark, SF)
    (given,) = calls
    sizes = {"restarts", "rounds", "depth", "trees", "folds"} & set(given)
    assert all(given[x] >= signature.parameters[x].default for x in sizes)
    if name.startswith("M17"):
        assert set(given["min_comments"]) == {2, 5, 10} and set(given["thresholds"]) == {0.05, 0.1, 0.25, 0.5}


def test_equal_rows_fold_and_keep_their_number(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    rows = models.folded(df, ["y", "a"]).collect()
    assert len(rows) == 6 and sum(r["_weight"] for r in rows) == 1000


def test_ranks_of_folded_rows(spark):
    df = spark.range(500).select((F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    plain = stats.rank_statistics(df, "v", F.col("y") == 1).first()
    counts = df.groupBy("v", "y").agg(F.count("*").alias("n"))
    assert stats.rank_statistics(counts, "v", F.col("y") == 1, rows=F.col("n")).first() == plain

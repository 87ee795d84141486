"""Attribution of a forest's scores to features along the paths of its trees.

The trees are a table of nodes, each with the share of positive rows it saw in training. A row walks from the root of
every tree to a leaf; a step to a child moves the expected score from the node's share to the child's, and that
difference belongs to the feature the node splits on. Summed over a path the steps lead from the root's share to the leaf's, so base
plus contributions is the score exactly. The table is bounded by the number and depth of the trees and goes to the
tasks; rows are walked a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "tree int, node int, feature int, threshold double, low int, high int, share double, leaf boolean"


def node_table(model: PipelineModel) -> list[tuple]:
    """The nodes of the pipeline's forest as rows of ``NODE``; a tree's nodes are numbered from 0, its root."""
    out = []
    for t, tree in enumerate(model.stages[-1].trees):
        nodes, waiting = [], [tree._call_java("rootNode")]
        while waiting:
            place = len(nodes)
            node = waiting.pop(0)
            stats = [float(x) for x in node.impurityStats().stats()]
            share = stats[1] / sum(stats)
            if node.subtreeDepth() == 0:
                nodes.append([t, place, -1, 0.0, place, place, share, True])
                continue
            low = place + len(waiting) + 1
            nodes.append([t, place, node.split().featureIndex(), float(node.split().threshold()), low, low + 1, share, False])
            waiting += [node.leftChild(), node.rightChild()]
        out += map(tuple, nodes)
    return out


class Trees:
    """The node table as arrays, trees one after another."""

    def __init__(self, nodes: list[tuple]):
        tree = np.array([n[0] for n in nodes])
        self.first = np.searchsorted(tree, np.arange(tree[-1] + 1))
        at = self.first[tree]
        self.feature = np.array([n[2] for n in nodes])
        self.threshold = np.array([n[3] for n in nodes])
        self.low, self.high = np.array([n[4] for n in nodes]) + at, np.array([n[5] for n in nodes]) + at
        self.share = np.array([n[6] for n in nodes])

    def base(self) -> float:
        return float(self.share[self.first].mean())

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """What each feature adds to the score of each row, the mean over the trees."""
        out = np.zeros(x.shape)
        every = np.arange(len(x))
        for root in self.first:
            at = np.full(len(x), root)
            while True:
                open_ = np.flatnonzero(self.feature[at] >= 0)
                if not len(open_):
                    break
                node = at[open_]
                f = self.feature[node]
                child = np.where(x[open_, f] <= self.threshold[node], self.low[node], self.high[node])
                out[every[open_], f] += self.share[child] - self.share[node]
                at[open_] = child
        return out / len(self.first)


def attributed(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """``key``, ``base``, ``c_<feature>`` for every feature, ``score``: base and contributions add up to the score."""
    trees = Trees(node_table(model))
    names = [f"c_{f}" for f in features]
    rows = model.transform(df).select(
        key, vector_to_array("features").alias("x"), F.element_at(vector_to_array("probability"), 2).alias("score"))
    kind = rows.schema[key].dataType.simpleString()
    base = trees.base()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = trees.contributions(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(names)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(c), base)), *[pa.array(c[:, i].copy()) for i in range(len(names))], batch.column(2)],
                names=[key, "base", *names, "score"])

    schema = f"{key} {kind}, base double, " + ", ".join(f"{n} double" for n in names) + ", score double"
    return rows.mapInArrow(run, schema)


def attribution_table(contributions: DataFrame, df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """Per feature the mean absolute contribution and its rank, mean, median, deviation, least and largest, and the
    sign of the correlation between value and contribution."""
    both = contributions.join(df.select(key, *features), key)
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.col(f"c_{f}").alias("c")) for f in features]))
    r = F.corr("x", "c")
    table = both.select(cells.alias("cell")).select("cell.*").groupBy("feature").agg(
        F.avg(F.abs("c")).alias("importance"), F.avg("c").alias("mean"), F.percentile_approx("c", 0.5, 10_000).alias("median"),
        F.stddev_samp("c").alias("std"), F.min("c").alias("least"), F.max("c").alias("largest"),
        F.when(r > 0, "raises").when(r < 0, "lowers").otherwise("none").alias("direction"))
    higher = table.select(F.col("feature").alias("_f"), F.col("importance").alias("_i"))  # a row per feature
    above = (F.col("_i") > F.col("importance")) | ((F.col("_i") == F.col("importance")) & (F.col("_f") < F.col("feature")))
    ranks = table.join(higher, above, "left").groupBy("feature").agg((F.count("_f") + 1).alias("rank"))
    return table.join(ranks, "feature")

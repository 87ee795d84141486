"""Resampling: bootstrap of means and of U, and Monte-Carlo label flips.

Draws are a hash of (row key, replicate), so a lost task repeats the same draws. Means need only sums per
replicate, which fold map-side. U needs the order of the values: rows are range-partitioned by value once,
and each task walks its sorted rows in Arrow batches with one running total per replicate. A task hands on
three units (its first value, its last value, all between); the units of all tasks are then put together.
The first and last value stand alone because a frequent value may lie in several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtide.functions import special
from threadtide.operators.ranks import global_row_number
from threadtide.operators.stats import rank_statistics
from threadtide.session import spread

PRIME = 2147483647
BATCH = 512


def draws(keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from row keys and replicates, by modular squaring: a matrix, rows by replicates."""
    k = (keys.astype(np.int64) % PRIME)[:, None]
    r = reps.astype(np.int64)[None, :]
    a = (k * 48271 + r * 69621 + 12345) % PRIME
    b = (a * a + r) % PRIME
    return ((b * b + a) % PRIME) / float(PRIME)


def _poisson_cdf(mean: float = 1.0) -> list[float]:
    """Cumulative probabilities up to the resolution of the draws."""
    out, p, total, k = [], math.exp(-mean), 0.0, 0
    while total < 1 - 1e-10:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return out


POISSON_CDF = _poisson_cdf()


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson counts for one mean per row, by inversion."""
    m = mean[:, None]
    p = np.exp(-m)
    total = p.copy() * np.ones_like(u)
    out = np.zeros(u.shape, dtype=np.int64)
    k = 0
    last = 60 + 20 * int(mean.max(initial=0.0))  # beyond this the mass is below the resolution of the draws
    todo = u >= total
    while todo.any() and k < last:
        k += 1
        out += todo
        p = p * m / k
        total = total + p
        todo = u >= total
    return out


def bootstrap_mean_difference(df: DataFrame, value: str, label: str, key: str, replicates: int = 1000) -> DataFrame:
    """Mean and 95% interval of the bot minus human mean over Poisson bootstrap replicates.

    A task keeps one sum and one count of weights per class and replicate, and hands on those; rows are not multiplied.
    """
    rows = spread(df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.col(label).alias("l")))
    reps = np.arange(1, replicates + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, replicates))  # of weight and weight times value, human and bot
        for part in batches:
            part = part[part["l"].isin([0, 1]) & part["v"].notna()]
            for low in range(0, len(part), BATCH):
                some = part.iloc[low : low + BATCH]
                w = poisson(draws(some["k"].to_numpy(), reps), np.ones(len(some))).astype(float)
                v, bot = some["v"].to_numpy(dtype=float), some["l"].to_numpy() == 1
                for k, x in enumerate((~bot, bot)):
                    sums[2 * k] += w[x].sum(axis=0)
                    sums[2 * k + 1] += v[x] @ w[x]
        yield pd.DataFrame({"rep": reps, "w0": sums[0], "s0": sums[1], "w1": sums[2], "s1": sums[3]})

    parts = rows.mapInPandas(run, "rep long, w0 double, s0 double, w1 double, s1 double")
    sums = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("w0", "s0", "w1", "s1")])
    per = sums.select((F.try_divide("s1", "w1") - F.try_divide("s0", "w0")).alias("d"))
    return interval(per, "d").select("replicates", "mean", "low", "high", (F.col("low") > 0).alias("significant"))


def interval(per: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation and central 95% interval over the replicates (one row each)."""
    return per.agg(
        F.count(value).alias("replicates"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        _quantile(value, 0.025).alias("low"),
        _quantile(value, 0.975).alias("high"),
    )


def _quantile(value: str, p: float) -> Column:
    """Linear interpolation from the lower neighbour, over one value per replicate."""
    ordered = F.array_sort(F.collect_list(value))
    at = (F.size(ordered) - 1) * F.lit(p)
    low, high = (F.get(ordered, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


Weights = Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]

_UNIT = "single boolean, v double, c1 array<double>, c0 array<double>, u array<double>, s1 array<double>, s0 array<double>"


def _walk(weights: Weights, replicates: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The task side: sorted rows in, three units out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zero = np.zeros(replicates)
        first = last = None  # [value, c1, c0]
        mid1, mid0, mid_u, mid_v = zero.copy(), zero.copy(), zero.copy(), None
        sum1, sum0 = zero.copy(), zero.copy()

        def close(seg):
            nonlocal mid1, mid0, mid_u, mid_v
            value, c1, c0 = seg
            if mid_v is None:
                mid_v = value
            mid_u += c1 * (mid0 + c0 / 2)
            mid1 += c1
            mid0 += c0

        for whole in batches:
            for start in range(0, len(whole), BATCH):
                part = whole.iloc[start:start + BATCH]
                v = part["v"].to_numpy(dtype=float)
                w1, w0 = weights(part)
                sum1 += v @ w1
                sum0 += v @ w0
                heads = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                s1, s0 = np.add.reduceat(w1, heads, axis=0), np.add.reduceat(w0, heads, axis=0)
                for i, h in enumerate(heads):
                    if last is not None and last[0] == v[h]:
                        last = [v[h], last[1] + s1[i], last[2] + s0[i]]
                        if first[0] == v[h]:
                            first = last
                        continue
                    if last is not None and last is not first:
                        close(last)
                    last = [v[h], s1[i], s0[i]]
                    if first is None:
                        first = last
        if first is None:
            return
        rows = [(True, first[0], first[1], first[2], zero)]
        if last is not first:
            rows.append((True, last[0], last[1], last[2], zero))
        if mid_v is not None:
            rows.append((False, mid_v, mid1, mid0, mid_u))
        out = [(s, float(v), a, b, u, sum1 if i == 0 else zero, sum0 if i == 0 else zero)
               for i, (s, v, a, b, u) in enumerate(rows)]
        yield pd.DataFrame(out, columns=["single", "v", "c1", "c0", "u", "s1", "s0"])

    return run


def replicated_u(df: DataFrame, value: str, extra: Sequence[str], key: str, weights: Weights, replicates: int) -> DataFrame:
    """Per replicate: U of the first sample, both sizes and both value sums.

    ``weights`` maps a batch to two matrices (rows by replicates): how often each row counts in either
    sample. Ties of a frequent value are spread by the key.
    """
    rows = df.select(F.col(value).cast("double").alias("v"), F.col(key).alias("k"), *extra)
    ordered = rows.repartitionByRange(F.col("v"), F.col("k")).sortWithinPartitions("v", "k")
    units = ordered.mapInPandas(_walk(weights, replicates), _UNIT)
    cells = F.arrays_zip("c1", "c0", "u", "s1", "s0")
    long = units.select("single", "v", F.posexplode(cells).alias("rep", "x")).groupBy("rep", "v", "single").agg(
        *[F.sum(f"x.{c}").alias(c) for c in ("c1", "c0", "u", "s1", "s0")])
    below = Window.partitionBy("rep").orderBy("v", "single").rowsBetween(Window.unboundedPreceding, -1)  # a few per task
    before = F.coalesce(F.sum("c0").over(below), F.lit(0.0))
    inside = F.when(F.col("single"), F.col("c1") * F.col("c0") / 2).otherwise(F.col("u"))
    return long.withColumn("part", inside + F.col("c1") * before).groupBy("rep").agg(
        F.sum("part").alias("u"), F.sum("c1").alias("n1"), F.sum("c0").alias("n0"),
        F.sum("s1").alias("sum1"), F.sum("s0").alias("sum0"))


def weighted_u(df: DataFrame, value: str, label: str, weight: str, key: str, replicates: int = 1000) -> DataFrame:
    """U over Poisson resamples in which a row's rate is its share of its sample's weight."""
    one = F.col(label) == 1
    rates = df.agg(*[(F.count_if(x) / F.sum(F.when(x, F.col(weight)))).alias(n) for n, x in (("one", one), ("zero", ~one))])
    rate = F.when(one, rates.select("one").scalar()).otherwise(rates.select("zero").scalar())
    rated = df.where(F.col(label).isNotNull()).withColumn("_m", rate * F.col(weight))
    reps = np.arange(1, replicates + 1)

    def weights(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        w = poisson(draws(part["k"].to_numpy(), reps), part["_m"].to_numpy(dtype=float)).astype(float)
        one = (part["_l"].to_numpy() == 1)[:, None]
        return w * one, w * ~one

    rated = rated.withColumn("_l", F.col(label))
    per = replicated_u(rated, value, ["_m", "_l"], key, weights, replicates)
    return interval(per, "u").select("replicates", F.col("mean").alias("u_weighted_mean"),
                                     F.col("low").alias("u_ci_low"), F.col("high").alias("u_ci_high"))


def beside_unweighted(df: DataFrame, value: str, label: str, weight: str, key: str, replicates: int = 1000) -> DataFrame:
    """The plain U test and, in the same row, the weighted one with the mean weight of both samples."""
    plain = rank_statistics(df, value, F.col(label) == 1).select("n1", "n0", "u", "p_value", F.lit(1).cast("bigint").alias("tests"))
    one = F.col(label) == 1
    means = df.agg(F.avg(F.when(one, F.col(weight))).alias("weight_bots"), F.avg(F.when(~one, F.col(weight))).alias("weight_humans"))
    return plain.crossJoin(weighted_u(df, value, label, weight, key, replicates)).crossJoin(means)  # one row each


def affine_steps(n: int, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """Per replicate a multiplier coprime to n and a shift: i -> (a i + c) mod n permutes 0..n-1."""
    a, c = [], []
    for r in range(1, replicates + 1):
        step = (r * 7919 * 104729 + 12345) % max(n, 1) or 1
        while math.gcd(step, n) != 1:
            step = step % n + 1
        a.append(step)
        c.append((r * 15485863) % max(n, 1))
    return np.array(a, dtype=np.int64), np.array(c, dtype=np.int64)


def label_flips(df: DataFrame, value: str, label: str, key: str, rates: Sequence[float],
                replicates: int = 1000) -> DataFrame:
    """Robustness of the U test when a share of the labels is wrong.

    Rows get one random place by their hash; a replicate permutes the places affinely and flips those
    that come first, so exactly int(n * rate) distinct rows flip in each without ranking per replicate.
    """
    from threadtide.operators.sampling import hash_key

    placed = global_row_number(
        df.select(F.col(value).alias("_v"), F.col(label).alias("_l"), F.col(key).alias("_k")),
        [hash_key("_k"), F.col("_k")], "place")
    n = int(placed.agg(F.max("place_total")).first()[0])
    a, c = affine_steps(n, replicates)
    cut = np.array([int(n * r) for r in rates], dtype=np.int64)

    def weights(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        i = (part["place"].to_numpy(dtype=np.int64) - 1)[:, None]
        at = np.concatenate([(i * a[None, :] + c[None, :]) % n < k for k in cut], axis=1)
        one = (part["_l"].to_numpy() == 1)[:, None] ^ at
        return one.astype(float), (~one).astype(float)

    per = replicated_u(placed, "_v", ["_l", "place"], "_k", weights, replicates * len(rates))
    ties = df.groupBy(F.col(value)).agg(F.count("*").cast("double").alias("t")).agg(
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t"))).scalar()
    n1, n0 = F.col("n1"), F.col("n0")
    size = n1 + n0
    sigma2 = n1 * n0 / 12 * ((size + 1) - ties / (size * (size - 1)))
    z = (F.col("u") - n1 * n0 / 2 - 0.5) / F.sqrt(sigma2)
    tested = per.where((n1 > 10) & (n0 > 10)).select(
        F.floor(F.col("rep") / replicates).cast("int").alias("rate_index"),
        (F.col("sum1") / n1 - F.col("sum0") / n0).alias("d"), z.alias("z"))
    p = tested.withColumn("p", special.normal_tail(F.col("z")))
    names = df.sparkSession.createDataFrame([(i, float(r)) for i, r in enumerate(rates)], "rate_index int, error_rate double")
    return p.groupBy("rate_index").agg(
        F.count("*").alias("replicates"),
        (F.count_if(F.col("p") < 0.05) / F.lit(replicates) * 100).alias("robustness"),
        F.avg("d").alias("mean_diff"),
        F.stddev_pop("d").alias("std_diff"),
        F.percentile("d", 0.025).alias("low"),
        F.percentile("d", 0.975).alias("high"),
    ).join(names, "rate_index").drop("rate_index")

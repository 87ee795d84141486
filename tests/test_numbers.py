"""Ranks, tests, evaluation, resampling and models against brute force and published values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadtide.functions import special
from threadtide.operators import evaluate, ranks, resample, sampling, stats, users


def mid_ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = [(i, rnd.choice([0.0, 0.0, round(rnd.random(), 2)]), rnd.randint(0, 1), rnd.choice("ab")) for i in range(400)]
    return data, spark.createDataFrame(data, "k long, v double, l int, g string")


def test_mid_ranks_with_a_hot_value(rows):
    data, df = rows
    got = {r["k"]: r["rank"] for r in ranks.with_mid_ranks(df, "v", "rank").collect()}
    assert got == dict(zip([d[0] for d in data], mid_ranks([d[1] for d in data])))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(rows, by):
    data, df = rows
    out = ranks.exact_quantiles(df, "v", [0.1, 0.5, 0.9], by, ["a", "b", "c"]).collect()
    for r in out:
        values = [d[1] for d in data if not by or d[3] == r["g"]]
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])))


def test_row_numbers(rows):
    data, df = rows
    got = ranks.global_row_number(df, [F.desc("v"), F.asc("k")]).collect()
    want = {d[0]: i for i, d in enumerate(sorted(data, key=lambda d: (-d[1], d[0])), 1)}
    assert {r["k"]: r["row_number"] for r in got} == want


def test_u_by_all_pairs(rows):
    data, df = rows
    one, zero = [d[1] for d in data if d[2] == 1], [d[1] for d in data if d[2] == 0]
    u = sum((a > b) + 0.5 * (a == b) for a in one for b in zero)
    r = stats.rank_statistics(df, "v", F.col("l") == 1).first()
    s = stats.rank_statistics(df, "v", F.col("l") == 0).first()
    assert r["u"] == pytest.approx(u) and r["u"] + s["u"] == pytest.approx(len(one) * len(zero))
    assert r["delta"] == pytest.approx(2 * u / (len(one) * len(zero)) - 1)


def test_tails(spark):
    zs = [-9.0, -3.0, -0.5, 0.0, 1.0, 1.96, 3.9, 4.1, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", special.normal_tail(F.col("z")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-9)
    assert special.f_tail(4.0, 1, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.f_tail(1.0, 5, 5) == pytest.approx(0.5)
    assert special.u_tail(9, 3, 3) == pytest.approx(0.05)
    assert list(special.u_counts(2, 2)) == [1, 1, 2, 1, 1]


def test_thresholds_without_humans_are_insufficient(spark):
    df = spark.createDataFrame([(1, 0.9, float(i)) for i in range(30)], "label int, ai_confidence double, rbi double")
    assert stats.conclusion(stats.threshold_tests(df)).first()["conclusion"] == "INSUFFICIENT"


GOLDEN = [
    ((18354, 1317, 4514, 3697), (0.7909, 0.5591)),
    ((6310, 537, 1619, 3456), (0.8192, 0.7622)),
    ((3125, 328, 1274, 3318), (0.8009, 0.8055)),
]


@pytest.mark.parametrize("cells, want", GOLDEN)
def test_published_confusions(spark, cells, want):
    tn, fp, fn, tp = cells
    parts = [spark.range(n).select(F.lit(y).alias("y"), F.lit(p).alias("p"))
             for n, y, p in ((tn, 0, 0), (fp, 0, 1), (fn, 1, 0), (tp, 1, 1))]
    df = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    r = evaluate.binary_metrics(df, "y", "p").first()
    assert (round(r["accuracy"], 4), round(r["f1"], 4)) == want
    report = {x["class"]: x for x in evaluate.class_report(df, "y", "p").collect()}
    assert report["1"]["support"] == fn + tp and report["1"]["f1"] == pytest.approx(r["f1"])


def test_splits_are_disjoint_and_complete(rows):
    data, df = rows
    out = sampling.stratified_split(df, "l", "k", {"train": 0.8, "test": 0.2}).collect()
    assert sorted(r["k"] for r in out) == [d[0] for d in data]
    for label in (0, 1):
        part = [r["part"] for r in out if r["l"] == label]
        assert abs(part.count("train") - 0.8 * len(part)) <= 1


def test_votes(spark):
    df = spark.createDataFrame([("u", "b", 0.5), ("u", "a", 0.5), ("w", "b", 0.6), ("w", "a", 0.5)], "commenter_id string, l string, p double")
    got = {r["commenter_id"]: r["l_weighted"] for r in users.weighted_votes(df, [("l", "p")]).collect()}
    assert got == {"u": "a", "w": "b"}


def test_replicated_u_equals_brute_force(rows):
    data, df = rows
    reps = 5

    def weights(part):
        k = part["k"].to_numpy()[:, None]
        w = ((k * 7 + np.arange(reps)[None, :]) % 3).astype(float)
        one = (part["l"].to_numpy() == 1)[:, None]
        return w * one, w * ~one

    got = {r["rep"]: r["u"] for r in resample.replicated_u(df, "v", ["l"], "k", weights, reps).collect()}
    for rep in range(reps):
        one = [(d[1], (d[0] * 7 + rep) % 3) for d in data if d[2] == 1]
        zero = [(d[1], (d[0] * 7 + rep) % 3) for d in data if d[2] == 0]
        u = sum(w * x * ((a > b) + 0.5 * (a == b)) for a, w in one for b, x in zero)
        assert got[rep] == pytest.approx(u)


def test_flips_are_exact():
    n, k = 97, 12
    a, c = resample.affine_steps(n, 20)
    for s, t in zip(a, c):
        assert sum((i * s + t) % n < k for i in range(n)) == k


def test_poisson_inversion():
    u = resample.draws(np.arange(2000), np.arange(1, 50))
    assert 0.49 < u.mean() < 0.51
    w = resample.poisson(u, np.full(2000, 2.5))
    assert abs(w.mean() - 2.5) < 0.05 and abs(w.var() - 2.5) < 0.1


def test_two_way_anova_balanced(spark):
    cells = {("Left", 0): [1, 2, 3], ("Left", 1): [2, 3, 4], ("Right", 0): [3, 4, 5], ("Right", 1): [6, 7, 8]}
    df = spark.createDataFrame([(a, b, float(v)) for (a, b), vs in cells.items() for v in vs], "s string, l int, v double")
    got = {r["term"]: r for r in stats.two_way_anova(df, "v", "s", ["Left", "Right"], "l", [0, 1]).collect()}
    assert got["s"]["sum_sq"] == pytest.approx(27) and got["l"]["sum_sq"] == pytest.approx(12)
    assert got["s:l"]["sum_sq"] == pytest.approx(3) and got["s:l"]["f_stat"] == pytest.approx(3)


def test_pls_with_one_predictor_is_correlation():
    fit = stats.pls_path({"xx": [[1.0]], "xy": [0.6]}, ["a"])
    assert fit["coef"]["a"] == pytest.approx(0.6) and fit["r2"] == pytest.approx(0.36)


@pytest.mark.parametrize("d2, p", [(10, 0.3408931323), (1e10, 0.3173105079), (1e12, 0.3173105079)])
def test_tail_at_many_degrees_of_freedom(d2, p):
    assert special.f_tail(1.0, 1.0, d2) == pytest.approx(p, rel=1e-9)


def test_u_counts_by_enumeration():
    from itertools import combinations

    for m, n in ((1, 4), (3, 4), (4, 4)):
        want = [0] * (m * n + 1)
        for places in combinations(range(m + n), m):
            want[sum(places) - m * (m - 1) // 2] += 1
        assert special.u_counts(m, n).tolist() == want

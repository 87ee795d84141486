"""Tail probabilities. The normal tail is a column expression; F, t and small-sample U use a tiny UDF
that only ever sees result rows (one per test), never data rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_tail(z: Column) -> Column:
    """P(Z > z): power series near 0, continued fraction in the tail."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / F.lit(math.sqrt(2 * math.pi))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(a.alias("term"), a.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * a * a / (k * 2 + 1)).alias("term"),
            (acc["total"] + acc["term"] * a * a / (k * 2 + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k / acc)
    upper = F.when(a < 4, F.lit(0.5) - density * series).otherwise(density / fraction)
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1_000_000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"the fraction has not settled for {a}, {b}, {x}")


def _stirling_rest(n: float) -> float:
    """log(n!) less Stirling's formula."""
    if n <= 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    s = 1.0 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - s / 1188) * s) * s) * s) / n


def _deviance(x: float, m: float) -> float:
    """x log(x / m) + m - x without loss of digits where x is near m."""
    if abs(x - m) >= 0.1 * (x + m):
        return x * math.log(x / m) + m - x
    v = (x - m) / (x + m)
    total, power, j = (x - m) * v, 2 * x * v, 1
    while True:
        power *= v * v
        more = total + power / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def beta_inc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function; ``y`` is 1 - x where that is known to more digits."""
    y = 1.0 - x if y is None else y
    if x <= 0:
        return 0.0
    if y <= 0:
        return 1.0
    n = a + b
    rest = _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b) - _deviance(a, n * x) - _deviance(b, n * y)
    front = math.sqrt(a * b / (2 * math.pi * n)) * math.exp(rest)
    if y > (b + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def f_tail(f: float, d1: float, d2: float) -> float | None:
    if f is None or d1 is None or d2 is None or any(map(math.isnan, (f, d1, d2))) or d1 <= 0 or d2 <= 0:
        return None
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


@F.pandas_udf(T.DoubleType())
def f_test_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F > f) with d1 and d2 degrees of freedom, one value per test row."""
    return pd.Series([f_tail(*row) for row in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic, one value per test row."""
    return pd.Series([None if v is None else f_tail(v * v, 1.0, d) for v, d in zip(t, df)], dtype="float64")


def u_counts(m: int, n: int) -> np.ndarray:
    """How many of the C(m+n, m) orderings give U = 0, 1, ..., m*n."""
    size = m * n + 1
    ways = np.zeros(size)
    ways[0] = 1.0
    for i in range(1, m + 1):
        top = n + i
        if top < size:
            ways[top:] -= ways[: size - top].copy()
        rows = -(-size // i)
        ways = np.cumsum(np.pad(ways, (0, rows * i - size)).reshape(rows, i), axis=0).ravel()[:size]
    return ways


def u_tail(u: float, m: int, n: int) -> float:
    """Exact P(U >= u) without ties."""
    m, n = min(m, n), max(m, n)
    ways = u_counts(m, n)
    return float(ways[math.ceil(u):].sum() / ways.sum())


@F.pandas_udf(T.DoubleType())
def small_sample_u_p(u: pd.Series, n1: pd.Series, n0: pd.Series, tied: pd.Series, p: pd.Series) -> pd.Series:
    """Exact p where a sample has at most 8 values and nothing is tied, else the given p."""
    return pd.Series(
        [
            u_tail(a, int(b), int(c)) if 0 < min(b, c) <= 8 and not t else q
            for a, b, c, t, q in zip(u, n1, n0, tied, p)
        ],
        dtype="float64",
    )

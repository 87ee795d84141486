"""SQL fragments that several twins share: mid-ranks, tail probabilities and hash draws for DuckDB."""

from __future__ import annotations


def normal_tail(z: str) -> str:
    """P(Z > z) by the power series of the normal integral, flat beyond |z| = 8."""
    body = (
        f"0.5e0 - sign({z}) * list_sum(list_transform(range(0, 160), lambda i_: exp((2 * i_ + 1) * ln(abs({z}) + 1e-300)"
        f" - {z} * {z} / 2 - (i_ + 0.5e0) * ln(2e0) - lgamma(i_ + 1.5e0)))) / 2"
    )
    return f"CASE WHEN {z} > 8 THEN 0e0 WHEN {z} < -8 THEN 1e0 ELSE {body} END"


def f_tail(f: str, d1: str, d2: str) -> str:
    """P(F > f): Simpson's rule on the incomplete beta integral after u = x exp(-v * v / a)."""
    a, b = f"({d2} / 2e0)", f"({d1} / 2e0)"
    x = f"({d2} / ({d2} + {d1} * {f}))"
    v = "(i_ * 1.6e-3)"
    front = f"exp({a} * ln({x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) - ln({a}))"
    g = f"2 * {v} * exp(-{v} * {v}) * pow(1 - {x} * exp(-{v} * {v} / {a}), {b} - 1)"
    w = "CASE WHEN i_ = 0 OR i_ = 4000 THEN 1 WHEN mod(i_, 2) = 1 THEN 4 ELSE 2 END"
    return f"{front} * list_sum(list_transform(range(0, 4001), lambda i_: ({w}) * {g})) * 1.6e-3 / 3"


def u_test(source: str, value: str, one: str, by: str = "") -> str:
    """CTE body: per group n1, n0, means, u, z, delta, p from plain window ranks."""
    part = f"PARTITION BY {by}" if by else ""
    keep = f"{by}, " if by else ""
    tie = f"PARTITION BY {keep}v"
    return f"""
  SELECT {keep} n1, n0, s1 / nullif(n1, 0) AS mean1, s0 / nullif(n0, 0) AS mean0, u, z, delta, ties > 0 AS tied,
         {normal_tail('z')} AS p_value
  FROM (SELECT *, CASE WHEN n1 > 0 AND n0 > 0 THEN 2 * u / (n1 * 1e0 * n0) - 1 END AS delta,
               (u - n1 * 1e0 * n0 / 2 - 0.5e0) / sqrt(n1 * 1e0 * n0 / 12 * ((n1 + n0 + 1)
                 - ties / ((n1 + n0) * 1e0 * (n1 + n0 - 1)))) AS z
        FROM (SELECT {keep} count(*) FILTER (one = 1) AS n1, count(*) FILTER (one = 0) AS n0,
                     sum(v) FILTER (one = 1) AS s1, sum(v) FILTER (one = 0) AS s0,
                     sum(r) FILTER (one = 1) - count(*) FILTER (one = 1) * 1e0 * (count(*) FILTER (one = 1) + 1) / 2 AS u,
                     sum(t * t - 1e0) AS ties
              FROM (SELECT {keep} v, one, count(*) OVER ({tie}) * 1e0 AS t,
                           rank() OVER ({part} ORDER BY v) + (count(*) OVER ({tie}) - 1) / 2e0 AS r
                    FROM (SELECT {keep} {value} AS v, CASE WHEN {one} THEN 1 ELSE 0 END AS one FROM {source}) a) b
              {f'GROUP BY {by}' if by else ''}) c) d"""


def threshold_sql(value: str, thresholds: list[float], passes: str, min_each: int = 10, min_rows: int = 0,
                  source: str = "x") -> str:
    """Twin of ``threshold_tests``: one row per threshold."""
    rows = ", ".join(f"({t}e0)" for t in thresholds)
    ok = f"(coalesce(n1, 0) > {min_each} AND coalesce(n0, 0) > {min_each} AND coalesce(n1, 0) + coalesce(n0, 0) > {min_rows})"
    return f"""
, g(threshold) AS (VALUES {rows}),
w AS (SELECT * FROM {source} CROSS JOIN g WHERE {passes}),
t AS ({u_test('w', value, 'label = 1', 'threshold')})
SELECT g.threshold, coalesce(n1, 0) AS n_bots, coalesce(n0, 0) AS n_humans,
       CASE WHEN {ok} THEN round(mean1, 9) END AS bot_mean, CASE WHEN {ok} THEN round(mean0, 9) END AS human_mean,
       CASE WHEN {ok} THEN round(mean1 - mean0, 9) END AS difference, CASE WHEN {ok} THEN round(u, 3) END AS u_stat,
       CASE WHEN {ok} THEN round(p_value, 6) END AS p_value, CASE WHEN {ok} THEN round(delta, 9) END AS cliffs_delta,
       CASE WHEN {ok} THEN p_value < 0.05e0 END AS significant, CASE WHEN NOT {ok} THEN 'insufficient' END AS error
FROM g LEFT JOIN t ON g.threshold = t.threshold"""

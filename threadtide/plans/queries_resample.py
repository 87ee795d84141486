"""Resampling queries over the scored comments."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from threadtide.functions import index as ix
from threadtide.operators import resample as rs
from threadtide.plans.queries_users import rounded
from threadtide.plans.registry import query
from threadtide.plans.sqltext import normal_tail, u_test
from threadtide.plans.views import indexed_comments, sc_sql

REPS = 1000


def draw_sql(key: str, rep: str) -> str:
    p = rs.PRIME
    a = f"mod(mod({key}, {p}) * 48271 + {rep} * 69621 + 12345, {p})"
    b = f"mod({a} * {a} + {rep}, {p})"
    return f"(mod({b} * {b} + {a}, {p}) / {p}e0)"


POISSON = "CASE " + " ".join(f"WHEN u < {e!r}::DOUBLE THEN {k}" for k, e in enumerate(rs.POISSON_CDF)) + f" ELSE {len(rs.POISSON_CDF)} END"


@query("X15_bootstrap_interval", sc_sql(f"""
, d AS (SELECT rep, label, rbi, {draw_sql('comment_id', 'rep')} AS u FROM x, range(1, 1001) r(rep)),
w AS (SELECT rep, label, rbi, {POISSON} AS w FROM d),
m AS (SELECT rep, sum(w * rbi) FILTER (label = 1) / sum(w) FILTER (label = 1)
           - sum(w * rbi) FILTER (label = 0) / sum(w) FILTER (label = 0) AS d FROM w GROUP BY 1)
SELECT count(*) AS replicates, round(avg(d), 9) AS mean, round(quantile_cont(d, 0.025), 9) AS low,
       round(quantile_cont(d, 0.975), 9) AS high, quantile_cont(d, 0.025) > 0 AS significant FROM m"""))
def _(spark, sf):
    return rounded(rs.bootstrap_mean_difference(indexed_comments(spark, sf), "rbi", "label", "comment_id"))


# Cumulative Poisson sums for a rate per row, to the twentieth term.
STEPS = " + ".join(
    f"CASE WHEN u >= exp(-m) * ({' + '.join(f'pow(m, {j}) / {f}e0' for j, f in enumerate(fs))}) THEN 1 ELSE 0 END"
    for fs in [[math.factorial(j) for j in range(k + 1)] for k in range(18)])


@query("X2_weighted_u", sc_sql(f"""
, y AS (SELECT comment_id, label, rbi, ai_confidence + 0.5e0 AS wt FROM x),
t AS (SELECT label, count(*) / sum(wt) AS rate FROM y GROUP BY 1),
d AS (SELECT rep, y.label, rbi, rate * wt AS m, {draw_sql('comment_id', 'rep')} AS u FROM y JOIN t ON y.label = t.label,
      range(1, {REPS + 1}) r(rep)),
w AS (SELECT rep, rbi, label, {STEPS} AS w FROM d),
v AS (SELECT rep, rbi, coalesce(sum(w) FILTER (label = 1), 0) AS c1, coalesce(sum(w) FILTER (label = 0), 0) AS c0 FROM w GROUP BY ALL),
k AS (SELECT rep, c1 * ((sum(c0) OVER (PARTITION BY rep ORDER BY rbi)) - c0 / 2e0) AS part FROM v),
u AS (SELECT rep, CAST(sum(part) AS DOUBLE) AS u FROM k GROUP BY 1)
SELECT count(*) AS replicates, round(avg(u), 3) AS u_weighted_mean, round(quantile_cont(u, 0.025), 3) AS u_ci_low,
       round(quantile_cont(u, 0.975), 3) AS u_ci_high FROM u"""))
def _(spark, sf):
    rows = indexed_comments(spark, sf).withColumn("wt", F.col("ai_confidence") + 0.5)
    return rounded(rs.weighted_u(rows, "rbi", "label", "wt", "comment_id", REPS), u_weighted_mean=3, u_ci_low=3, u_ci_high=3)


@query("X2_beside_unweighted", sc_sql(f"""
SELECT n1, n0, round(u, 3) AS u, round(p_value, 6) AS p_value, {REPS} AS replicates, CAST(1 AS BIGINT) AS tests,
       (SELECT round(avg(ai_confidence + 0.5e0) FILTER (label = 1), 9) FROM x) AS weight_bots,
       (SELECT round(avg(ai_confidence + 0.5e0) FILTER (label = 0), 9) FROM x) AS weight_humans
FROM ({u_test('x', 'rbi', 'label = 1')}) t"""))
def _(spark, sf):
    rows = indexed_comments(spark, sf).withColumn("wt", F.col("ai_confidence") + 0.5)
    both = rs.beside_unweighted(rows, "rbi", "label", "wt", "comment_id", REPS)
    out = both.select("n1", "n0", "u", "p_value", F.col("replicates").cast("int").alias("replicates"), "tests", "weight_bots", "weight_humans")
    return rounded(out, u=3, p_value=6)


RATES = (0.05, 0.15, 0.20)


def flips_sql(rates: str) -> str:
    return sc_sql(f"""
, pl AS (SELECT rbi, label, row_number() OVER (ORDER BY md5('42|' || CAST(comment_id AS VARCHAR)), comment_id) - 1 AS i,
         count(*) OVER () AS n FROM x),
e(error_rate) AS ({rates}),
co AS (SELECT n, s FROM (SELECT max(n) AS n FROM pl) a, LATERAL (SELECT s FROM range(1, n + 1) g(s) WHERE gcd(s, n) = 1) b),
ab AS (SELECT r AS rep, coalesce(min(s) FILTER (s >= st), min(s)) AS a, max(mod(r * 15485863, n)) AS c
       FROM (SELECT r, n, s, CASE WHEN mod(r * 829348951 + 12345, n) = 0 THEN 1 ELSE mod(r * 829348951 + 12345, n) END AS st
             FROM range(1, {REPS + 1}) q(r), co) z GROUP BY 1),
fl AS (SELECT error_rate, rep, rbi, CASE WHEN mod(i * a + c, n) < CAST(floor(n * error_rate) AS BIGINT) THEN 1 - label ELSE label END AS l
       FROM pl, ab, e),
v AS (SELECT error_rate, rep, rbi, count(*) FILTER (l = 1) AS c1, count(*) FILTER (l = 0) AS c0 FROM fl GROUP BY ALL),
k AS (SELECT *, c1 * ((sum(c0) OVER (PARTITION BY error_rate, rep ORDER BY rbi)) - c0 / 2e0) AS part FROM v),
u AS (SELECT error_rate, rep, CAST(sum(part) AS DOUBLE) AS u, sum(c1) * 1e0 AS n1, sum(c0) * 1e0 AS n0,
      sum(rbi * c1) / sum(c1) - sum(rbi * c0) / sum(c0) AS d,
      sum(pow((c1 + c0) * 1e0, 3) - (c1 + c0)) AS ties FROM k GROUP BY ALL),
zz AS (SELECT error_rate, d, (u - n1 * n0 / 2 - 0.5e0) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM u)
SELECT error_rate, count(*) AS replicates, round(count(*) FILTER (({normal_tail('z')}) < 0.05e0) * 1e0 / {REPS} * 100, 9) AS robustness,
       round(avg(d), 9) AS mean_diff, round(stddev_pop(d), 9) AS std_diff, round(quantile_cont(d, 0.025), 9) AS low,
       round(quantile_cont(d, 0.975), 9) AS high FROM zz GROUP BY 1""")


@query("X14_label_flips", flips_sql("VALUES (0.05e0), (0.15e0), (0.2e0)"))
def _(spark, sf):
    return rounded(rs.label_flips(indexed_comments(spark, sf), "rbi", "label", "comment_id", RATES, REPS))


@query("X14_error_rates", f"""SELECT round(error_rate, 9) AS error_rate, replicates, robustness, mean_diff, std_diff, low, high,
       CASE WHEN robustness >= 95 THEN 'ROBUST' WHEN robustness >= 80 THEN 'SENSITIVE' ELSE 'NOT ROBUST' END AS class
FROM ({flips_sql("SELECT avg(1 - greatest(ai_confidence, 1 - ai_confidence)) FROM sc")}) q""")
def _(spark, sf):
    # the estimated error rate of the labels is one of the tested rates
    df = indexed_comments(spark, sf).withColumn(
        "sure", F.greatest("ai_confidence", 1 - F.col("ai_confidence")))
    rate = df.agg(F.avg(1 - F.col("sure"))).first()[0]
    out = rs.label_flips(df, "rbi", "label", "comment_id", [rate], REPS)
    return rounded(out).withColumn("class", ix.robustness_class(F.col("robustness")))

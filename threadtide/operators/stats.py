"""Rank tests, analysis of variance and correlations from one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtide.functions import special
from threadtide.operators.ranks import exact_quantiles, mid_rank, ordered_counts
from threadtide.operators.skew import join_hot
from threadtide.session import cut_lineage


def rank_statistics(df: DataFrame, value: str, first: Column, by: Sequence[str] = (), rows: Column | None = None) -> DataFrame:
    """Per group: sizes, means, U of the ``first`` sample, tie term, z, one-sided p and Cliff's delta. ``rows`` says how many
    rows a folded row stands for."""
    by = list(by)
    rows = F.lit(1).cast("bigint") if rows is None else rows
    flagged = df.select(*by, F.col(value).cast("double").alias("_v"), first.cast("bigint").alias("_one"), rows.alias("_rows"))
    counts = ordered_counts(flagged.where(F.col("_one").isNotNull()), "_v", by, {"k": F.col("_one") * F.col("_rows")},
                            rows=F.col("_rows"))
    return rank_statistics_of(counts, "_v", by)


def rank_statistics_of(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The same from ordered counts whose sum ``k`` counts the first sample."""
    n, k, v = F.col("n").cast("double"), F.col("k").cast("double"), F.col(value)
    sums = counts.groupBy(*by).agg(
        F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("n1"),
        F.coalesce(F.sum(F.col("n") - F.col("k")), F.lit(0)).cast("bigint").alias("n0"),
        F.sum(k * mid_rank()).alias("_r1"),
        F.sum(n * n * n - n).alias("_ties"),
        F.sum(v * k).alias("_s1"),
        F.sum(v * (n - k)).alias("_s0"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    both = (n1 > 0) & (n0 > 0)
    total = n1 + n0
    sigma2 = n1 * n0 / 12 * ((total + 1) - F.col("_ties") / (total * (total - 1)))
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    with_u = sums.select(
        *by,
        "n1",
        "n0",
        F.when(n1 > 0, F.col("_s1") / n1).alias("mean1"),
        F.when(n0 > 0, F.col("_s0") / n0).alias("mean0"),
        F.when(both, u).alias("u"),
        F.when(both & (sigma2 > 0), (u - n1 * n0 / 2 - 0.5) / F.sqrt(sigma2)).alias("z"),
        F.when(both, 2 * u / (n1 * n0) - 1).alias("delta"),
        (F.col("_ties") > 0).alias("tied"),
    )
    return with_u.withColumn("p_value", special.normal_tail(F.col("z")))


def by_threshold(df: DataFrame, conf: str, thresholds: Sequence[float], two_sided: bool = False) -> DataFrame:
    """Rows repeated once per threshold they pass (at most len(thresholds) times), in one pass."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    c = F.col(conf)

    def passes(t: Column) -> Column:
        return (c >= t) | (c <= F.lit(1.0) - t) if two_sided else c >= t

    return df.withColumn("threshold", F.explode(F.filter(grid, passes)))


def threshold_tests(
    df: DataFrame,
    value: str = "rbi",
    label: str = "label",
    conf: str = "ai_confidence",
    thresholds: Sequence[float] = (0.5, 0.7, 0.9),
    two_sided: bool = False,
    min_each: int = 10,
    min_rows: int = 0,
) -> DataFrame:
    """U test, means, difference, p and delta per threshold.

    A threshold whose samples are too small keeps its row, with NULL statistics and an error text.
    """
    spark = df.sparkSession
    tests = rank_statistics(by_threshold(df, conf, thresholds, two_sided), value, F.col(label) == 1, ["threshold"])
    grid = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    n1, n0 = F.coalesce("n1", F.lit(0)), F.coalesce("n0", F.lit(0))
    ok = (n1 > min_each) & (n0 > min_each) & (n1 + n0 > min_rows)
    return grid.join(tests, "threshold", "left").select(
        "threshold",
        n1.cast("bigint").alias("n_bots"),
        n0.cast("bigint").alias("n_humans"),
        F.when(ok, F.col("mean1")).alias("bot_mean"),
        F.when(ok, F.col("mean0")).alias("human_mean"),
        F.when(ok, F.col("mean1") - F.col("mean0")).alias("difference"),
        F.when(ok, F.col("u")).alias("u_stat"),
        F.when(ok, F.col("p_value")).alias("p_value"),
        F.when(ok, F.col("delta")).alias("cliffs_delta"),
        F.when(ok, F.col("p_value") < 0.05).alias("significant"),
        F.when(~ok, "insufficient").alias("error"),
    )


def conclusion(tests: DataFrame) -> DataFrame:
    """Verdict over a threshold table; INSUFFICIENT when no test ran at all."""
    ran = F.count("significant")
    return tests.agg(
        ran.alias("tests_run"),
        F.when(ran == 0, "INSUFFICIENT")
        .when(F.bool_and("significant"), "SUPPORTED")
        .otherwise("PARTIAL/NOT SUPPORTED")
        .alias("conclusion"),
    )


def guarded_test(
    df: DataFrame, value: str, first: Column, min_each: int, exact_small: bool = False, min_rows: int = 0
) -> DataFrame:
    """Q6: one U test as one row, or an error text when a sample has ``min_each`` values or fewer, or both have
    fewer than ``min_rows``."""
    t = rank_statistics(df, value, first)
    if exact_small:
        t = t.withColumn("p_value", special.small_sample_u_p("u", "n1", "n0", "tied", "p_value"))
    ok = (F.col("n1") > min_each) & (F.col("n0") > min_each) & (F.col("n1") + F.col("n0") >= min_rows)
    return t.select(
        "n1",
        "n0",
        *[F.when(ok, F.col(c)).alias(c) for c in ("mean1", "mean0", "u", "z", "delta", "p_value")],
        F.when(~ok, F.concat(F.lit("insufficient samples (bots="), F.col("n1").cast("string"),
                             F.lit(", humans="), F.col("n0").cast("string"), F.lit(")"))).alias("error"),
    )


def pearson_table(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """R of every feature with the target, |r| and t, pairwise non-null, from one aggregation."""
    aggs = []
    for f in features:
        both = F.col(f).isNotNull() & F.col(target).isNotNull()
        aggs += [F.corr(f, target).alias(f"r_{f}"), F.count_if(both).alias(f"n_{f}")]
    rows = F.explode(
        F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f"r_{f}").alias("r"), F.col(f"n_{f}").alias("n"))
            for f in features
        ])
    )
    r, n = F.col("r"), F.col("n")
    return (
        df.agg(*aggs).select(rows.alias("x")).select("x.*")
        .select(
            "feature", "n", "r", F.abs(r).alias("abs_r"),
            F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r))).alias("t"),
        )
    )


def with_p(table: DataFrame) -> DataFrame:
    """Two-sided p of the rows of ``pearson_table``."""
    return table.withColumn("p_value", special.t_test_p(F.col("t"), (F.col("n") - 2).cast("double")))


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The upper triangle of the Pearson matrix as rows (a, b, r)."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs
    ]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def spearman_table(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rank correlation of every feature with the target.

    The columns are unpivoted, ranked in one go with the column name as the group, and the rank sums
    are taken over the joined pairs of ranks. Rows with a NULL in a pair are left out of that pair.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("a"), F.col(target).cast("double").alias("b"))
        for f in features
    ]))
    long = df.select(pairs.alias("x")).select("x.*").where("a IS NOT NULL AND b IS NOT NULL")
    folded = cut_lineage(long.groupBy("feature", "a", "b").agg(F.count("*").alias("w")))
    rank_a = _weighted_ranks(folded, "a", "ra")
    rank_b = _weighted_ranks(folded, "b", "rb")
    # a value that meets many others is joined in several places
    ranked = join_hot(join_hot(folded, rank_a, ["feature", "a"]), rank_b, ["feature", "b"])
    w, ra, rb = F.col("w").cast("double"), F.col("ra") - F.col("_c"), F.col("rb") - F.col("_c")
    moments = ranked.withColumn("_c", (F.col("_n") + 1) / 2).groupBy("feature").agg(
        F.sum("w").cast("bigint").alias("n"),
        F.sum(w * ra * rb).alias("_ab"),
        F.sum(w * ra * ra).alias("_aa"),
        F.sum(w * rb * rb).alias("_bb"),
    )
    return moments.select(
        "feature", "n", (F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))).alias("rho")
    )


def _weighted_ranks(folded: DataFrame, value: str, name: str) -> DataFrame:
    counts = ordered_counts(folded, value, ["feature"], {"k": F.col("w")})
    rank = F.col("k_before") + (F.col("k") + 1) / 2
    extra = [F.col("k_total").alias("_n")] if value == "a" else []
    return counts.select("feature", value, rank.alias(name), *extra)


def one_way_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """F over the groups from counts, sums and centred squares; error when a group set is too small."""
    v = F.col(value)
    cells = df.where(v.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").cast("double").alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2")
    )
    levels = Window.partitionBy(F.lit(0))  # one row per group level
    mean = F.sum(F.col("n") * F.col("m")).over(levels) / F.sum("n").over(levels)
    n, m = F.col("n"), F.col("m")
    joined = cells.withColumn("mean", mean).agg(
        F.count("*").alias("groups"),
        F.sum(n).alias("rows"),
        F.sum(n * (m - F.col("mean")) * (m - F.col("mean"))).alias("ss_between"),
        F.sum(F.coalesce((n - 1) * F.col("s2"), F.lit(0.0))).alias("ss_within"),
    )
    d1, d2 = (F.col("groups") - 1).cast("double"), F.col("rows") - F.col("groups")
    ok = (F.col("groups") >= 2) & (d2 > 0)
    return joined.select(
        F.col("groups").cast("bigint").alias("n_groups"),
        F.col("rows").cast("bigint").alias("n"),
        F.when(ok, F.col("ss_between")).alias("ss_between"),
        F.col("ss_within"),
        F.when(ok, F.col("ss_between") / d1 / (F.col("ss_within") / d2)).alias("f_stat"),
        F.when(~ok, "need at least two groups").alias("error"),
    )


def two_way_anova(df: DataFrame, value: str, a: str, a_levels: Sequence, b: str, b_levels: Sequence,
                  min_rows: int = 0) -> DataFrame:
    """2x2 type-II analysis of variance with interaction, in closed form from the four cells."""
    v = F.col(value)
    names, aggs = [], []  # cells 11, 12, 21, 22
    for i, la in enumerate(a_levels, 1):
        for j, lb in enumerate(b_levels, 1):
            hit = F.when((F.col(a) == la) & (F.col(b) == lb), v)
            names.append(f"{i}{j}")
            aggs += [
                F.count(hit).cast("double").alias(f"n{i}{j}"),
                F.avg(hit).alias(f"m{i}{j}"),
                F.var_samp(hit).alias(f"v{i}{j}"),
            ]
    row = df.agg(*aggs)
    n = {k: F.col(f"n{k}") for k in names}
    m = {k: F.col(f"m{k}") for k in names}
    total = n["11"] + n["12"] + n["21"] + n["22"]
    ok = (n["11"] > 0) & (n["12"] > 0) & (n["21"] > 0) & (n["22"] > 0) & (total > 4) & (total >= min_rows)

    def main_effect(pairs: list[tuple[str, str]]) -> Column:
        weights = [n[p] * n[q] / (n[p] + n[q]) for p, q in pairs]
        dot = sum((w * (m[p] - m[q]) for w, (p, q) in zip(weights, pairs)), F.lit(0.0))
        return dot * dot / sum(weights, F.lit(0.0))

    contrast = m["11"] - m["12"] - m["21"] + m["22"]
    inverse = sum((F.lit(1.0) / n[k] for k in names), F.lit(0.0))
    residual = sum((F.coalesce((n[k] - 1) * F.col(f"v{k}"), F.lit(0.0)) for k in names), F.lit(0.0))
    terms = F.array(
        F.struct(F.lit(a).alias("term"), main_effect([("11", "21"), ("12", "22")]).alias("ss")),
        F.struct(F.lit(b).alias("term"), main_effect([("11", "12"), ("21", "22")]).alias("ss")),
        F.struct(F.lit(f"{a}:{b}").alias("term"), (contrast * contrast / inverse).alias("ss")),
    )
    return (
        row.select(total.alias("n"), ok.alias("ok"), residual.alias("ss_residual"), F.explode(terms).alias("t"))
        .select(
            F.col("t.term").alias("term"),
            F.col("n").cast("bigint").alias("n"),
            F.when(F.col("ok"), F.col("t.ss")).alias("sum_sq"),
            F.when(F.col("ok"), F.col("ss_residual")).alias("ss_residual"),
            F.when(F.col("ok"), F.col("t.ss") / (F.col("ss_residual") / (F.col("n") - 4))).alias("f_stat"),
            F.when(~F.col("ok"), "insufficient data").alias("error"),
        )
    )


def anova_p(table: DataFrame, d1: Column, d2: Column) -> DataFrame:
    """p of the F statistics of a table."""
    return table.withColumn("p_value", special.f_test_p(F.col("f_stat"), d1.cast("double"), d2.cast("double")))


def reply_variance(df: DataFrame, sentiment: str, offensive: str, population: bool = False) -> DataFrame:
    """Emotional variance of the replies below each parent with at least two replies.

    Replies are folded by parent before any join, so a parent with very many replies is one row.
    """
    var = F.var_pop if population else F.var_samp
    return (
        df.where(F.col("parent_id").isNotNull())
        .groupBy("parent_id")
        .agg(
            F.count("*").alias("n_replies"),
            var(sentiment).alias("sentiment_var"),
            var(offensive).alias("offensive_var"),
        )
        .where("n_replies >= 2")
        .withColumn("ev", F.col("sentiment_var") + F.col("offensive_var"))
    )


def roots_with_variance(df: DataFrame, sentiment: str, offensive: str, population: bool = False) -> DataFrame:
    """Root comments with the variance of their direct replies."""
    replies = reply_variance(df, sentiment, offensive, population)
    roots = df.where(F.col("parent_id").isNull())
    return roots.join(replies.withColumnRenamed("parent_id", "comment_id"), "comment_id")


def regression_lines(df: DataFrame, y: str, x: str, by: str) -> DataFrame:
    """Least-squares line per group."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def pls_path(moments: dict, predictors: Sequence[str], components: int = 2) -> dict:
    """X11: PLS1 from the correlation moments of p predictors and one response (a p x p problem)."""
    import numpy as np

    sxx, sxy = np.array(moments["xx"], float), np.array(moments["xy"], float)
    p = len(predictors)
    xx, xy = sxx.copy(), sxy.copy()
    weights, loadings, slopes = [], [], []
    for _ in range(min(components, p)):
        norm = np.linalg.norm(xy)
        if norm < 1e-15:
            break
        w = xy / norm
        tt = w @ xx @ w
        if tt < 1e-15:
            break
        load, slope = xx @ w / tt, (xy @ w) / tt
        xx = xx - tt * np.outer(load, load)
        xy = xy - tt * load * slope
        weights.append(w), loadings.append(load), slopes.append(slope)
    w, pl, q = np.array(weights).T, np.array(loadings).T, np.array(slopes)
    coef = w @ np.linalg.inv(pl.T @ w) @ q
    fitted = coef @ sxx @ coef
    r2 = 1 - (1 - 2 * coef @ sxy + fitted)
    return {"coef": dict(zip(predictors, coef.tolist())), "r2": float(r2)}


def pls_by_label(df: DataFrame, predictors: Sequence[str], response: str, label: str, min_rows: int = 10) -> DataFrame:
    """X11: standardised PLS coefficients and R2 per label; the data is read once, for moments only."""
    cols = [*predictors, response]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs = [F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]
    rows = df.na.drop(subset=cols).groupBy(label).agg(F.count("*").alias("n"), *aggs).collect()  # one row per label
    out = []
    p = len(predictors)
    for r in rows:
        if r["n"] < min_rows:
            continue
        c = [[float(r[f"c{min(i, j)}_{max(i, j)}"] or 0.0) if i != j else 1.0 for j in range(p + 1)]
             for i in range(p + 1)]
        fit = pls_path({"xx": [x[:p] for x in c[:p]], "xy": [x[p] for x in c[:p]]}, predictors)
        out.append((int(r[label]), int(r["n"]), *[float(fit["coef"][k]) for k in predictors], fit["r2"]))
    schema = f"{label} bigint, n bigint, " + ", ".join(f"coef_{k} double" for k in predictors) + ", r2 double"
    return df.sparkSession.createDataFrame(out, schema)


def trigger_efficiency(roots: DataFrame) -> DataFrame:
    """Mean variance per unit of mean index, for bots and humans, and their ratio."""
    def efficiency(k: int) -> Column:
        ev = F.avg(F.when(F.col("label") == k, F.col("ev")))
        return ev / (F.avg(F.when(F.col("label") == k, F.col("rbi"))) + 0.001)

    return roots.agg(efficiency(1).alias("bot_efficiency"), efficiency(0).alias("human_efficiency")).withColumn(
        "ratio", F.col("bot_efficiency") / F.col("human_efficiency")
    )


def enough_rows(results: DataFrame, df: DataFrame, least: int, what: str) -> DataFrame:
    """Q6: the row of a test with all figures NULL and an error text when the data has fewer than ``least`` rows."""
    n = df.agg(F.count("*")).scalar()
    few = n < least
    return results.select(*[
        F.when(few, F.concat(F.lit(f"insufficient {what} ("), n.cast("string"), F.lit(" rows)"))).otherwise(F.col("error")).alias("error")
        if c == "error" else F.when(~few, F.col(c)).alias(c) for c in results.columns])


def leaning_groups(df: DataFrame, value: str, leaning: str = "leaning", label: str = "label", min_rows: int = 100) -> DataFrame:
    """One-way test over the groups of leaning and label (six with three leanings); an error text for fewer rows."""
    rows = df.where(F.col(leaning).isin("Left", "Right", "Neutral") & F.col(label).isin(0, 1)).withColumn(
        "_group", F.concat_ws("_", F.lower(leaning), F.when(F.col(label) == 1, "bot").otherwise("human")))
    t = one_way_anova(rows, value, "_group")
    tested = anova_p(t, F.col("n_groups") - 1, F.col("n") - F.col("n_groups"))
    found = F.when(F.col("p_value") < 0.05, "INTERACTION FOUND").when(F.col("p_value").isNotNull(), "NO SIGNIFICANT INTERACTION")
    return enough_rows(tested.withColumn("conclusion", found), rows, min_rows, "data after merge")


def trigger_effect(df: DataFrame, share: float = 0.75, min_each: int = 5) -> DataFrame:
    """U test on reply variance, bots against humans, among roots in the upper quartile of the index.

    The roots are read by the quantile and by the test, so they are written once to the shared folder.
    """
    roots = roots_with_variance(df, "sentiment_prob", "offensive_prob").select(
        "label", "rbi", F.round("ev", 12).alias("ev")  # equal variances must tie whatever the order of addition
    )
    roots = cut_lineage(roots)
    edge = exact_quantiles(roots, "rbi", [share], names=["q"]).select("q").scalar()
    high = roots.where(F.col("rbi") >= edge)
    return guarded_test(high, "ev", F.col("label") == 1, min_each, exact_small=True)

"""Global order without a one-task window.

``ordered_counts`` folds a column to its distinct values, cuts the value axis into buckets at
approximate quantiles, and gives every value the totals that lie before it: running sums inside a
bucket plus the totals of the buckets below (one row per bucket). A value shared by a third of the
rows is a single row after the fold, so no bucket grows with the skew of the data.

``global_row_number`` numbers whole rows by a composite key: range partitioning balances ties through
the later key columns, and one written stage pins the numbering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadtide.operators.skew import join_hot
from threadtide.session import cut_lineage

MIN_BUCKETS = 32


def bucket_count(spark: SparkSession) -> int:
    """Buckets of the value axis: a few per shuffle partition, so the work spreads over the cluster."""
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BUCKETS, wanted)


def _with_bucket(df: DataFrame, value: str, cuts: Column, buckets: int) -> DataFrame:
    """Add ``_bucket``: how many of the ``buckets`` - 1 sorted cut points are <= value. The search halves its
    stride in one plain projection per step, which stay inside generated code."""
    out = df.withColumns({"_cuts": cuts, "_bucket": F.lit(0)})
    step = 1 << ((buckets - 1).bit_length() - 1)
    while step:
        passed = F.get("_cuts", F.col("_bucket") + (step - 1)) <= F.col(value)
        out = out.withColumn("_bucket", F.col("_bucket") + F.when(passed, step).otherwise(0))
        step //= 2
    return out.drop("_cuts")


def ordered_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    buckets: int | None = None,
    rows: Column | None = None,
) -> DataFrame:
    """One row per distinct (by, value) with ``n``, the sums, and for each of them ``<x>_before``
    (total over smaller values of the group) and ``<x>_total``. NULL and NaN values are left out. ``n`` counts rows, or
    adds up how many ``rows`` each stands for."""
    by = list(by)
    sums = sums or {}
    buckets = buckets or bucket_count(df.sparkSession)
    v = F.col(value).cast("double")
    counts = (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*by, v.alias(value))
        .agg((F.count("*") if rows is None else F.sum(rows)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    )
    grid = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    cuts = counts.agg(F.expr(f"percentile_approx(`{value}`, array({grid}), {4 * buckets})")).scalar()
    placed = _with_bucket(counts, value, cuts, buckets)
    names = ["n", *sums]
    below = Window.partitionBy(*by, F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, F.lit(0))
    offsets = (
        placed.groupBy(*by, "_bucket")
        .agg(*[F.sum(x).alias(x) for x in names])
        .select(
            *by,
            "_bucket",
            *[F.coalesce(F.sum(x).over(below), F.lit(0)).alias(f"_{x}_below") for x in names],
            *[F.sum(x).over(whole).alias(f"{x}_total") for x in names],
        )
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"_{x}_in") for x in names])
        .join(offsets, [*by, "_bucket"])
        .select(
            *by,
            value,
            *names,
            *[(F.col(f"_{x}_below") + F.col(f"_{x}_in")).alias(f"{x}_before") for x in names],
            *[f"{x}_total" for x in names],
        )
    )


def mid_rank() -> Column:
    """Average rank of a value of ``ordered_counts``."""
    return F.col("n_before") + (F.col("n") + 1) / 2


def with_mid_ranks(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Every row with the average rank of its value; the value table is joined back on, a value that many rows
    share in several places."""
    by = list(by)
    ranks = ordered_counts(df, value, by).select(*by, F.col(value).alias("_v"), mid_rank().alias(name))
    keyed = df.withColumn("_v", F.col(value).cast("double"))
    return join_hot(keyed, ranks, [*by, "_v"]).drop("_v")


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group, read off the ordered counts."""
    names = names or [f"q{i}" for i in range(len(probs))]
    return quantiles_of(ordered_counts(df, value, by), value, probs, by, names)


def quantiles_of(
    counts: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], names: Sequence[str]
) -> DataFrame:
    def value_at(k: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col(value)))

    picks, outs = [], []
    for p, name in zip(probs, names):
        h = (F.col("n_total") - 1) * F.lit(float(p))
        picks += [value_at(F.floor(h)).alias(f"_lo_{name}"), value_at(F.ceil(h)).alias(f"_hi_{name}")]
        frac = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * (frac - F.floor(frac))).alias(name))
    rows = counts.groupBy(*by).agg(F.max("n_total").alias("_n"), *picks)
    return rows.select(*by, F.col("_n").alias("n"), *outs)


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Rows numbered 1..N by ``order``, which should be unique. One range shuffle, one written stage."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    pinned = cut_lineage(ranged.withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_slot", 33)
    sizes = pinned.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy(F.lit(0))).alias("_all"),
    )
    within = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    # a row per partition of the numbered table
    return (
        pinned.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within + 1)
        .withColumnRenamed("_all", f"{name}_total")
        .drop("_part", "_slot", "_offset")
    )


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row holding the sorted distinct edges of a quantile cut."""
    probs = [i / bins for i in range(bins + 1)]
    cols = [f"e{i}" for i in range(bins + 1)]
    return exact_quantiles(df, value, probs, names=cols).select(
        F.array_sort(F.array_distinct(F.array(*cols))).alias("edges")
    )


def quantile_cut(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Right-closed quantile bin of every row, the lowest value included in bin 0."""
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    edged = df.withColumn("_edges", quantile_edges(df, value, bins).scalar())
    return edged.withColumn(name, F.greatest(below - 1, F.lit(0)).cast("bigint")).drop("_edges")

"""Mixing sources to target weights by entropy balancing.

Targets share ``share`` times all words by weight and stop at ``cap`` times a source's words; what is over goes
to the other sources by weight until none is above. Document rates are then the smallest departure, in relative
entropy, from taking every document once that meets two constraints in each source: its words come to the target,
and its documents to the same share, so that the mix does not turn to long or short texts. The convex dual has
two multipliers per source; documents get rates exp(a + b * size / mean size), and Newton steps on the multipliers
read sums over the documents, which are first folded to one row per source and size. Rates become copies by
carrying the rounding error on, from long documents to short ones, inside small hashed groups of each source.

Edge cases: a NULL text or one without words has size 0 and takes no words; NULL sources are one source, the
last; repeated rows are mixed each on its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtide.operators.ranks import global_row_number
from threadtide.session import cut_lineage

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
GROUP_ROWS, TOLERANCE, MAX_STEPS = 1024, 1e-9, 100
#: A table of sources up to this many rows is broadcast; beyond it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row (source, source_size) per source."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    numbered = global_row_number(sizes, [F.col("source").asc_nulls_last()])
    weighed = cut_lineage(
        numbered.select(
            "source",
            "source_size",
            F.get(cycle, F.pmod(F.col("row_number") - 1, F.lit(len(weights))).cast("int")).alias("weight"),
            (F.lit(cap) * F.col("source_size")).alias("most"),
        )
    )
    wanted = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    rate, free = 0.0, -1
    while True:  # each round stops at least one more source, or is the last
        full = F.lit(rate) * F.col("weight") >= F.col("most") if free >= 0 else F.lit(False)
        row = weighed.agg(
            F.sum(F.when(full, F.col("most"))).alias("taken"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(~full, 1)).alias("free"),
        ).first()
        if row["free"] in (free, 0):
            break
        free, rate = row["free"], (wanted - (row["taken"] or 0.0)) / row["weight"]
    return weighed.select(
        "source", "source_size", F.least("most", F.lit(rate) * F.col("weight")).alias("target")
    )


def rates(folded: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """``source``, ``a``, ``b``, ``mean``, ``fixed``: the multipliers of every source. ``folded`` has a row
    (source, size, n) per source and size."""
    totals = folded.groupBy("source").agg(F.sum("n").alias("n_docs"))
    state = cut_lineage(
        goals.join(totals, goals.source.eqNullSafe(totals.source)).select(
            goals.source,
            "source_size",
            "target",
            "n_docs",
            (F.col("source_size") / F.col("n_docs")).alias("mean"),
            # words of an empty source are 0 at any rate; a source that gives all it may has the rate cap
            F.when(F.col("source_size") == 0, 1.0).when(F.col("target") >= cap * F.col("source_size"), cap).alias("fixed"),
            F.lit(0.0).alias("a"),
            F.lit(0.0).alias("b"),
        )
    )
    z = F.col("size") / F.col("mean")
    for _ in range(MAX_STEPS):
        r = F.exp(F.col("a") + F.col("b") * z) * F.col("n")
        left = folded.withColumnRenamed("source", "of")
        sums = (
            left.join(state.where("fixed IS NULL"), F.col("of").eqNullSafe(F.col("source")))
            .groupBy("source")
            .agg(F.sum(r).alias("s0"), F.sum(r * z).alias("s1"), F.sum(r * z * z).alias("s2"))
            .withColumnRenamed("source", "of")
        )
        ratio = F.col("target") / F.col("source_size")
        g0, g1 = F.col("s0") - ratio * F.col("n_docs"), F.col("s1") - ratio * F.col("n_docs")
        det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        flat = det <= 1e-9 * F.col("s0") * F.col("s2")  # all documents of one size: one multiplier does
        da = F.when(flat, g1 / F.col("s1")).otherwise((F.col("s2") * g0 - F.col("s1") * g1) / det)
        db = F.when(flat, 0.0).otherwise((F.col("s0") * g1 - F.col("s1") * g0) / det)
        off = F.abs(g1) / (ratio * F.col("n_docs"))
        state = cut_lineage(
            state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").select(
                *[c for c in state.columns if c not in ("a", "b", "off")],
                F.coalesce(F.col("a") - da, "a").alias("a"),
                F.coalesce(F.col("b") - db, "b").alias("b"),
                F.coalesce(off, F.lit(0.0)).alias("off"),
            )
        )
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < TOLERANCE:
            return state
    raise RuntimeError("the multipliers have not settled")


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and falling size get whole copies; what rounding leaves is carried to the next row."""
    group, due = None, 0.0
    for batch in batches:
        out = []
        columns = (batch.column(i).to_pylist() for i in range(1, 4))
        for own, size, rate in zip(*columns):
            if own != group:
                group, due = own, 0.0
            due += rate * size
            n = int(rate + 0.5) if size == 0 else min(max(int(due / size + 0.5), 0), int(CAP))
            due -= n * size
            out.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "copies"])


def mix(docs: DataFrame, carry: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Every row as ``row`` (``carry``, by default its doc_id), ``size``, ``source_size``, ``target``, ``copies``."""
    sized = docs.select(
        (F.col("doc_id") if carry is None else carry).alias("row"), "doc_id", F.col("source").alias("of"), words(F.col("text")).alias("size")
    )
    folded = cut_lineage(
        sized.groupBy(F.col("of").alias("source"), "size").agg(F.count("*").alias("n"))
    )
    goals = targets(folded.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)
    state = rates(folded, goals)
    if state.count() <= BROADCAST_SOURCES:
        state = F.broadcast(state)
    groups = F.ceil(F.col("n_docs") / GROUP_ROWS)
    rate = F.coalesce("fixed", F.exp(F.col("a") + F.col("b") * F.col("size") / F.col("mean")))
    ready = sized.join(state, F.col("of").eqNullSafe(F.col("source"))).select(
        "row",
        F.xxhash64("source", F.pmod(F.xxhash64("doc_id"), groups)).alias("grp"),
        "size",
        F.least(rate, F.lit(CAP)).alias("rate"),
        "source_size",
        "target",
        "doc_id",
    )
    laid = ready.repartition("grp").sortWithinPartitions("grp", F.desc("size"), "doc_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields) + ", copies long"
    return laid.mapInArrow(_copies, schema).select("row", "size", "source_size", "target", "copies")

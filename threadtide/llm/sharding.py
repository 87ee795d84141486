"""Shards by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. A group of copies is kept as units, one per cell of 256 hash cells, so a
group that no shard can hold is spread over few. Units start on hashed shards. In each round a group votes for
the shard that holds most of its documents, ties by a hash of the round, and its other units ask to move there.
Shards exchange: of the requests from s to t and from t to s as many rows pass as stand against each other, and
what room there is besides, whole groups first come by hash while a shard can hold several of them, single units
otherwise. Counts by pair of shards and hash bucket decide how far requests are met, so no shard gets more than
its rows. After a round in which nothing moved, groups vote for shards with room only; rounds end when ``QUIET``
in a row move nothing. A move always adds to a shard that holds as much of the group or more, so they do end. Every shard takes N / 8 rows, at most one
apart: what linked documents leave free is filled with unlinked ones, and what a shard has above its rows moves
on with them. Places come from windows over hashed buckets and one row of offsets per bucket.

Edge cases: a NULL text has size 1, checksum 0 and no links; an empty text is a text; repeated rows get a place
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtide.session import cut_lineage

SHARDS, CELLS, BUCKET_ROWS, MIN_BUCKETS = 8, 256, 20_000, 64
#: Rounds without a move after which none is left; hash buckets by which requests are met.
QUIET, DRAWS = 4, 1024


def _lookup(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), at)


def _met(asked: dict[tuple[int, int], list[tuple[int, int]]], room: list[int]) -> dict[tuple[int, int], int]:
    """For each (from, to) the bucket below which requests are met, so that no shard gets more than its room.
    ``asked`` has (bucket, rows) in order; ``room`` is used up."""
    cut = {}

    def most(pair: tuple[int, int], rows: int) -> int:
        """The rows of the leading buckets that fit into ``rows``."""
        taken, cut[pair] = 0, 0
        for bucket, n in asked.get(pair, []):
            if taken + n > rows:
                break
            taken, cut[pair] = taken + n, bucket + 1
        return taken

    shards = range(len(room))
    wanted = {pair: sum(n for _, n in x) for pair, x in asked.items()}
    for s, t in combinations(shards, 2):
        there, back = wanted.get((s, t), 0), wanted.get((t, s), 0)
        while True:
            a = most((s, t), min(there, back + room[t]))
            b = most((t, s), min(back, a + room[s]))
            if a <= b + room[t]:
                break
            there, back = min(there, b + room[t]), b
        room[s] += a - b
        room[t] += b - a
    return cut


def propagate(units: DataFrame, room_of: list[int]) -> DataFrame:
    """``gkey``, ``cell``, ``n``, ``shard`` after the rounds; ``room_of`` has the rows each shard may hold."""
    shards = len(room_of)
    units = cut_lineage(
        units.withColumn("shard", F.pmod(F.xxhash64("gkey", "cell"), F.lit(shards)).cast("int"))
    )
    step = quiet = 0
    while quiet < QUIET:
        loads = {r["shard"]: r["n"] for r in units.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        room = [max(0, most - loads.get(s, 0)) for s, most in enumerate(room_of)]
        votes = units.groupBy("gkey", "shard").agg(F.sum("n").alias("w"))
        open_to = votes.where(_lookup(room, F.col("shard")) > 0) if quiet % 2 else votes
        first = F.max(F.struct("w", F.xxhash64("gkey", "shard", F.lit(step)).alias("tie"), "shard"))
        best = (
            open_to.groupBy("gkey")
            .agg(first.alias("first"))
            .select("gkey", F.col("first.shard").alias("target"), F.col("first.w").alias("there"))
            .join(votes.groupBy("gkey").agg(F.sum("w").alias("all")), "gkey")
        )
        whole = F.col("all") * 4 <= _lookup(room_of, F.col("target"))
        salt = F.lit(quiet)
        draw = F.when(whole, F.xxhash64("gkey", salt)).otherwise(F.xxhash64("gkey", "cell", salt))
        # documents on a shard that holds more of the group than the target stay there
        asked = cut_lineage(
            units.join(votes.withColumnRenamed("w", "own"), ["gkey", "shard"])
            .join(best, "gkey", "left")
            .select(
                "gkey",
                "cell",
                "n",
                "shard",
                F.when((F.col("target") != F.col("shard")) & (F.col("own") <= F.col("there")), F.col("target")).alias("target"),
                F.pmod(draw, F.lit(DRAWS)).cast("int").alias("draw"),
            )
        )
        counts = asked.where("target IS NOT NULL").groupBy("shard", "target", "draw").agg(F.sum("n").alias("n"))
        requests: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in counts.collect():  # at most DRAWS rows a pair of shards
            requests.setdefault((r["shard"], r["target"]), []).append((r["draw"], r["n"]))
        if not requests and not quiet % 2:
            break
        cut = _met({pair: sorted(x) for pair, x in requests.items()}, room)
        step, quiet = step + 1, 0 if any(cut.values()) else quiet + 1
        if quiet:
            continue
        met = _lookup([cut.get((s, t), 0) for s in range(shards) for t in range(shards)], F.col("shard") * shards + F.col("target"))
        units = asked.select(
            "gkey", "cell", "n", F.when(F.col("draw") < met, F.col("target")).otherwise(F.col("shard")).alias("shard")
        )
    return units


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` (gapless in the shard) for every row."""
    text = F.coalesce("text", F.lit(""))
    base = cut_lineage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5("text")).alias("gkey"),
            F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int").alias("cell"),
        )
    )
    total = base.count()
    rows_of = [total // shards + (s < total % shards) for s in range(shards)]
    cells = base.where("gkey IS NOT NULL").groupBy("gkey", "cell").agg(F.count("*").alias("n"))
    many = cells.groupBy("gkey").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("gkey")
    units = propagate(cells.join(many, "gkey", "left_semi"), rows_of)

    buckets = max(MIN_BUCKETS, -(-total // BUCKET_ROWS))
    labelled = (
        base.join(units.select("gkey", "cell", "shard"), ["gkey", "cell"], "left")
        .withColumn("part", F.coalesce("shard", F.lit(shards)))
        .withColumn(
            "bucket",
            F.pmod(F.when(F.col("part") < shards, F.xxhash64("gkey", "cell")).otherwise(F.xxhash64("doc_id", "gkey")), F.lit(buckets)),
        )
    )
    counts = cut_lineage(labelled.groupBy("part", "bucket").agg(F.count("*").alias("n")))
    offsets = counts.select(
        "part",
        "bucket",
        F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    linked = {r["part"]: r["n"] for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    held = [min(rows_of[s], linked.get(s, 0)) for s in range(shards)]
    over = [linked.get(s, 0) - held[s] for s in range(shards)]
    over_before = [sum(over[:s]) for s in range(shards)] + [sum(over)]
    free_to = [sum(rows_of[: s + 1]) - sum(held[: s + 1]) for s in range(shards)]
    free_from = [0, *free_to[:-1]]

    own = Window.partitionBy("part", "bucket").orderBy("gkey", "cell", "doc_id")
    placed = labelled.withColumn("nth", F.row_number().over(own) - 1).join(offsets, ["part", "bucket"])
    place = F.col("before") + F.col("nth")
    spare = place - _lookup([*held, 0], F.col("part")) + _lookup(over_before, F.col("part"))
    stays = (F.col("part") < shards) & (place < _lookup([*held, 0], F.col("part")))
    filled = placed.withColumn("stays", stays).withColumn("place", place).withColumn("spare", spare)
    goes = F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in free_to]), lambda x: x <= F.col("spare")))
    filled = filled.withColumn("to", F.when(F.col("stays"), F.col("part")).otherwise(goes))
    return filled.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("to").cast("int").alias("shard"),
        F.when(F.col("stays"), F.col("place"))
        .otherwise(F.col("spare") - _lookup(free_from, F.col("to")) + _lookup(held, F.col("to")))
        .cast("bigint")
        .alias("slot"),
    )

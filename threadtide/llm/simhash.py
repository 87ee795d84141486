"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two halves of 32 bits. Fingerprints that differ in at most four bits differ in at
most two bits of some half, so the balls of radius one around these halves meet: every fingerprint is filed
under the 33 keys of either ball, fingerprints that meet under a key are compared in full and leave a spanning tree of their links. Equal fingerprints
are one entry, so groups of exact copies cost nothing.

A key with more than ``LIGHT`` entries is not compared pair by pair. Its entries are filed once more under
every 64-bit number within two bits. Two of them within four bits share such a midpoint, and all that share
one are within four bits, so linking each to the smallest under the midpoint joins exactly what belongs
together, with work in proportion to the entries.

Edge cases: a NULL or empty text has fingerprint zero, linked like any other; fewer words than a shingle make
one shingle; repeated rows share fingerprint and component; a NULL doc_id is no candidate for a component's
id; other columns are ignored; an empty table gives no rows. ``first_of_groups`` treats rows with a NULL or shared
doc_id as rows of their own and keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtide.llm import textnum as tn
from threadtide.llm.components import components
from threadtide.session import cut_lineage

SHINGLE, SEED, BITS, LIGHT = 4, 42, 4, 512
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _block_fingerprints(block: tn.Block, shingle: int) -> np.ndarray:
    """Fingerprints of a block's rows. Words are lower-cased and joined by one space in numpy, so that every
    shingle is a slice of one bytes object."""
    data = LOWER[block.data]
    keep = ~tn.IS_SPACE[block.data]
    n_words = np.diff(block.first)
    last = np.zeros(len(block.starts), bool)
    last[block.first[1:][n_words > 0] - 1] = True
    joints = block.ends[~last]
    keep[joints] = True
    data[joints] = 32
    place = np.concatenate([[0], np.cumsum(keep)])
    text = data[keep].tobytes()
    starts, ends = place[block.starts], place[block.ends]

    counts = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    rows = np.repeat(np.arange(block.rows), counts)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = block.first[rows] + nth
    stop = np.minimum(begin + shingle, block.first[rows + 1]) - 1
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (one(text[a:b], SEED) for a, b in zip(starts[begin].tolist(), ends[stop].tolist())), np.uint64, len(rows)
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(block.rows, np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        votes = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * votes > counts[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, block in tn.blocks(batch.column(1)):
                fp = _block_fingerprints(block, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _roots(fp: np.ndarray) -> np.ndarray:
    """For each fingerprint under a light key the first one that links reach."""
    near = popcount(fp[:, None] ^ fp[None, :]) <= BITS
    root = np.arange(len(fp))
    while True:
        low = np.where(near, root[None, :], len(fp)).min(axis=1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _met(batches: Iterator[pa.RecordBatch], light: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: links under light keys, a spanning tree of each linked set and not its pairs; and
    with b NULL the entries of heavy keys.
    At most ``light`` rows of a key are carried from batch to batch."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    heavy_key = None

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
        return pa.RecordBatch.from_arrays([pa.array(a), b], names=["a", "b"])

    def settled(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.concatenate([begin, [len(key)]]))
        many = np.repeat(length > light, length)
        if many.any():
            yield out(fp[many], None)
        two = begin[length == 2]
        two = two[popcount(fp[two] ^ fp[two + 1]) <= BITS]
        found = [(fp[two], fp[two + 1])]
        for at, n in zip(*(x[(length > 2) & (length <= light)].tolist() for x in (begin, length))):
            own = fp[at : at + n]
            root = _roots(own)
            below = np.flatnonzero(root != np.arange(n))
            found.append((own[root[below]], own[below]))
        a, b = (np.concatenate(x) for x in zip(*found))
        if len(a):
            yield out(np.minimum(a, b), np.maximum(a, b))

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy()])
        if not len(key):
            continue
        if heavy_key is not None:
            old = int(np.searchsorted(key, heavy_key, "right"))
            if old:
                yield out(fp[:old], None)
                key, fp = key[old:], fp[old:]
            if not len(key):
                continue
            heavy_key = None
        tail = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - tail > light:
            heavy_key = key[-1]
            yield out(fp[tail:], None)
            key, fp, rest_key, rest_fp = key[:tail], fp[:tail], key[:0], fp[:0]
        else:
            key, fp, rest_key, rest_fp = key[:tail], fp[:tail], key[tail:], fp[tail:]
        if len(key):
            yield from settled(key, fp)
        key, fp = rest_key, rest_fp
    if len(key):
        yield from settled(key, fp)


def _masks(bits: int, radius: int) -> list[int]:
    sets = [c for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [sum(1 << i for i in c) for c in sets]


def _around(half: Column, ball: Column) -> Column:
    return F.transform(ball, lambda m: half.bitwiseXOR(m))


def links(fps: DataFrame, light: int = LIGHT) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` within ``BITS`` bits."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _met(batches, light)

    ball = F.array(*[F.lit(m).cast("bigint") for m in _masks(32, 1)])
    halves = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))]
    keys = F.concat(*[_around(h, ball) for h in halves])
    filed = fps.select("fp", F.explode(keys).alias("key")).select("key", "fp")
    met = cut_lineage(filed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long"))
    pairs = met.where("b IS NOT NULL").distinct()
    wide = np.array(_masks(64, 2), np.uint64).view(np.int64)

    def midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in batch.column(0).to_numpy():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wide), fp)), pa.array(wide ^ fp)], names=["a", "mid"])

    heavy = met.where("b IS NULL").select("a").distinct()
    around = heavy.mapInArrow(midpoints, "a long, mid long")
    stars = (
        around.join(around.groupBy("mid").agg(F.min("a").alias("b")).hint("merge"), "mid").where("a <> b").select("a", "b").distinct()
    )
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, light: int = LIGHT) -> DataFrame:
    """Every document with its fingerprint (16 hex digits) and the smallest doc_id that links reach."""
    prints = cut_lineage(fingerprints(docs, shingle))
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = cut_lineage(links(fps.select("fp"), light))
    found = components(edges, fps.select(F.col("fp").alias("node"), F.col("first_id").alias("value")))
    placed = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("value", "first_id").alias("component_id")
    )
    return prints.join(placed, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with one row of each group of near duplicates: the one with the smallest doc_id, NULL
    last; among rows with that doc_id the one whose columns hash lowest, and of equal rows one. Groups are found on keys of rows
    (doc_id and 128 bits of all columns), which stand for doc_id in ``near_duplicates``; equal rows fold in the tasks before
    any text is shuffled."""
    columns = [docs[c] for c in docs.columns]
    kind = docs.schema["doc_id"].dataType
    key = F.struct(
        docs["doc_id"].isNull().alias("none"), F.coalesce(docs["doc_id"], F.lit(0).cast(kind)).alias("id"),
        F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("more"))
    groups = near_duplicates(docs.select(key.alias("doc_id"), docs["text"].alias("text")))
    firsts = groups.where("doc_id = component_id").select("doc_id.*").distinct()
    rows = docs.select(key.alias("key"), F.struct(*columns).alias("row")).select("key.*", "row").dropDuplicates(firsts.columns)
    return rows.join(firsts, firsts.columns, "left_semi").select("row.*")

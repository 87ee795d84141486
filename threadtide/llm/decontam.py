"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-case words without ASCII punctuation. Hashes of all windows of ``SEED`` words, rolled
over prefix sums, meet the windows of the benchmark; where they meet in a row they make a maximal match. The
longest match is marked first, matches that run into marked words are cut down to what is free, and so on until
no free match of ``SEED`` words is left (items shorter than a seed have to stand there whole). A document is
contaminated by an item when its tiles cover ``COVERAGE`` of the item's words, in whatever order they come.

The benchmark is cut into blocks of bounded size; each is broadcast and meets all documents in one pass without a
shuffle, so a benchmark of any size is handled.

Edge cases: a NULL or empty text is clean; NULL or empty items match nothing; repeated rows are judged alike;
texts of any length are whole (matches are found block by block of rows); other columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtide.llm import textnum as tn
from threadtide.session import cut_lineage

SEED, COVERAGE, BLOCK_WORDS, FILTER_BITS = 5, 0.5, 1_000_000, 20
BLOCK_BYTES = 1 << 18  # of texts at once; hashes and their powers take some hundred times as much
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[:128] = [b if chr(b).isalnum() else 32 for b in range(128)]
PLAIN[65:91] += 32


def _hashes(block: tn.Block) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the plain form and where each row's begin."""
    plain = tn.Block(PLAIN[block.data], block.offsets)
    return plain.word_hashes(), plain.first


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``n``, ``words`` (the word hashes as bytes)."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, block in tn.blocks(batch.column(1), BLOCK_BYTES):
                words, first = _hashes(block)
                cut = [words[a:b] for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array([len(c) for c in cut], pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())],
                    names=["item_id", "n", "words"],
                )

    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, n long, words binary").where("n > 0")


class Index:
    """The seeds of one block of items: sorted hashes with item and place, and a small table to pass over most words."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(SEED, len(w)) for w in self.words}):
            own = [i for i, w in enumerate(self.words) if min(SEED, len(w)) == k]
            seeds = [tn.Prefix(self.words[i], tn.WORD_BASE).windows(k) for i in own]
            item = np.repeat(own, [len(s) for s in seeds])
            place = np.concatenate([np.arange(len(s)) for s in seeds])
            seed = np.concatenate(seeds)
            order = np.argsort(seed, kind="stable")
            table = np.zeros(1 << FILTER_BITS, bool)
            table[seed & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.by_length[k] = (seed[order], item[order], place[order], table)


def tiles(i: np.ndarray, j: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the starts (i in the item, j in the text) of equal windows of k words: (i, j, length)."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)]))
    length = np.diff(np.concatenate([new, [len(i)]])) + k - 1
    heap = [(-n, a, b) for n, a, b in zip(length.tolist(), i[new].tolist(), j[new].tolist())]
    heapq.heapify(heap)
    item_marks, text_marks = np.zeros(int((i[new] + length).max()), bool), set()
    done = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [not item_marks[a + x] and b + x not in text_marks for x in range(n)]
        if all(free):
            item_marks[a : a + n] = True
            text_marks.update(range(b, b + n))
            done.append((a, b, n))
            continue
        at = 0
        while at < n:
            end = at
            while end < n and free[end]:
                end += 1
            if end - at >= k:
                heapq.heappush(heap, (at - end, a + at, b + at))
            at = end + 1
    return done


def _matches(block: tn.Block, index: Index, coverage: float) -> Iterator[tuple[int, int, int]]:
    """(row, item, covered words) of the items covered far enough."""
    words, first = _hashes(block)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    prefix = tn.Prefix(words, tn.WORD_BASE)
    for k, (seed, item, place, table) in index.by_length.items():
        windows = prefix.windows(k)
        at = np.flatnonzero(table[windows & np.uint64((1 << FILTER_BITS) - 1)])
        at = at[row[at] == row[at + k - 1]]
        low, high = np.searchsorted(seed, windows[at], "left"), np.searchsorted(seed, windows[at], "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        if not len(at):
            continue
        hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        j, i, which = np.repeat(at, n), place[hit], item[hit]
        order = np.lexsort((which, row[j]))
        j, i, which = j[order], i[order], which[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 0) | (np.diff(row[j]) != 0)]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(j)]):
            own = index.words[which[a]]
            reach = np.zeros(len(own) + 1, np.int64)
            places = np.unique(i[a:b])
            np.add.at(reach, places, 1)
            np.subtract.at(reach, places + k, 1)
            if (np.cumsum(reach) > 0).sum() < coverage * len(own):
                continue  # tiles lie inside what the seeds cover
            found = tiles(i[a:b], j[a:b], k)
            covered = sum(n for x, y, n in found if (own[x : x + n] == words[y : y + n]).all())
            if covered >= coverage * len(own):
                yield int(row[j[a]]), int(which[a]), covered


def index_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """The benchmark in blocks of about ``block_words`` words, one at a time on the driver."""
    ready = cut_lineage(benchmark_words(benchmark))
    total = ready.agg(F.sum("n")).first()[0] or 0
    count = -(-total // block_words)
    for b in range(count):
        rows = ready.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == b).collect()
        items = [(r["item_id"], np.frombuffer(r["words"], np.uint64)) for r in sorted(rows, key=lambda r: bytes(r["words"]))]
        if items:
            yield Index(items)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_words`` of the item, ``covered`` words: every contamination."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, n_words long, covered long"
    spark, out = docs.sparkSession, None
    for index in index_blocks(benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                for low, high, block in tn.blocks(batch.column(1), BLOCK_BYTES):
                    found = list(_matches(block, index, coverage))
                    if found:
                        rows, items, covered = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0)[low:high].take(pa.array(rows)),
                                pa.array([index.ids[x] for x in items]),
                                pa.array([len(index.words[x]) for x in items], pa.int64()),
                                pa.array(covered, pa.int64()),
                            ],
                            names=["doc_id", "item_id", "n_words", "covered"],
                        )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, carry: Column, coverage: float = COVERAGE) -> DataFrame:
    """``row`` (``carry``) of every document that no item contaminates."""
    rest = docs.select(carry.alias("row"), "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields)
    for index in index_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for low, _, block in tn.blocks(batch.column(1), BLOCK_BYTES):
                    for row, _, _ in _matches(block, held.value, coverage):
                        keep[low + row] = False
                yield batch.filter(pa.array(keep))

        rest = rest.mapInArrow(run, schema)
    return rest.select("row")

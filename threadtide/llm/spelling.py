"""Spelling variants of corpus words: words one edit apart, found by pivotal grams.

Words have code points up to U+00FF only, so one byte each in ISO 8859-1, and at most 8,100 bigrams. Bigrams are
ordered by the number of their places in the vocabulary, rare ones first. The prefix of a word is its first three
grams of that order (with all that tie with the third); among any three there are two that share no
letter, and dynamic programming picks the two of least total number: the pivots. One edit spoils at most one of two
disjoint grams, so of two words one edit apart the word whose prefix ends first in the order has a pivot that the other
word holds too, and holds in its prefix. The place of that gram is known but for the difference in length.

So every word is filed under (gram, place, length) of its prefix grams, and asks with its pivots under the places and
lengths that one edit allows. Entries and askers of a key meet in numpy: letter parities first, then all letters. Keys
with many of both are split by their counts into cells of at most about ``CELL`` entries by ``CELL`` askers;
no candidate is left out. Work under a key is askers times entries, which grows faster than the vocabulary.

Edge cases: NULL and empty texts have no words; a NULL doc_id reads as an empty string; repeated rows count again;
words of any length are compared; without near words ``form`` and ``form_n`` are NULL, ``n_near`` is 0 and the root is
the word itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtide.llm import textnum as tn
from threadtide.session import cut_lineage

LEAST_LETTERS, LEAST_N, DAMAGE, RATIO = 5, 3, 97, 2
PREFIX = 3  # bigrams of which one edit can spoil two, and one more
BLOCK_BYTES, MATRIX, CELL, TILE = 1 << 22, 1 << 20, 4096, 1 << 19
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LEAD = 0xC3  # begins the two bytes of every character from U+00C0 to U+00FF
FEW = 8  # runs left, from which on they are finished one by one


def _crc_table() -> np.ndarray:
    """Remainders of single bytes, from the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of runs of bytes, each continued from ``before``, a step of all runs at a time."""
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that the open runs are a front part
    length, at = (ends - starts)[order], starts[order]
    crc = ~before[order].astype(np.uint32)
    step, n = 0, int(np.searchsorted(-length, 0, "left"))  # runs longer than step
    while n > FEW:
        crc[:n] = CRC[(crc[:n] ^ data[at[:n] + step]) & np.uint32(0xFF)] ^ crc[:n] >> np.uint32(8)
        step += 1
        n = int(np.searchsorted(-length, -step, "left"))
    crc = ~crc
    for i in range(n):
        crc[i] = zlib.crc32(data[at[i] + step : at[i] + length[i]], int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _runs(block: tn.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of letters."""
    data = block.data
    lead = data == LEAD
    inside = LETTERS[data] | lead
    inside[1:] |= lead[:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # rows touch each other without a blank, so a row's edge parts runs too
    inner = block.offsets[(block.offsets > 0) & (block.offsets < len(data))]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(block.offsets, starts, "right") - 1


def _found(block: tn.Block, ids: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The different words of a block in ISO 8859-1, damaged ones as they are found, and their counts."""
    starts, ends, row = _runs(block)
    lowered = LOWER[block.data]
    begun = np.array([zlib.crc32(b"%s:" % i) for i in ids], np.uint32)
    hit = crc32s(lowered, starts, ends, begun[row]) if len(starts) else np.zeros(0, np.uint32)
    letters = np.concatenate([[0], np.cumsum(lowered != LEAD)])  # before each byte: one byte a letter, its last
    size = letters[ends] - letters[starts]
    spoilt = hit % np.uint32(DAMAGE) == 0
    narrow = np.where(np.concatenate([[False], lowered[:-1] == LEAD]), lowered + np.uint8(0x40), lowered)[lowered != LEAD]

    keep = np.flatnonzero(size - spoilt >= LEAST_LETTERS)
    a, n = letters[starts[keep]], size[keep]
    at = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    place = np.arange(at[-1]) + np.repeat(a - at[:-1], n)
    if spoilt[keep].any():
        whole = np.ones(len(place), bool)
        hurt = np.flatnonzero(spoilt[keep])
        whole[at[hurt] + hit[keep][hurt].astype(np.int64) % n[hurt]] = False
        place = place[whole]
        np.cumsum(n - spoilt[keep], out=at[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keep), [None, pa.py_buffer(at), pa.py_buffer(narrow[place])])
    counted = words.value_counts()
    return counted.field(0).cast(pa.binary()), counted.field(1).to_numpy()


def vocabulary(docs: DataFrame, least_n: int = LEAST_N) -> DataFrame:
    """``w`` (ISO 8859-1) and ``n`` of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [i.encode() for i in batch.column(0).to_pylist()]
            for low, high, block in tn.blocks(batch.column(1), BLOCK_BYTES):
                words, n = _found(block, ids[low:high])
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["w", "n"])

    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return read.mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# ------------------------------------------------------------------------------------ grams

def _by_length(length: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of words of similar length, so that rows of letters as long as the longest waste little."""
    order = np.argsort(length, kind="stable")
    ordered, low = length[order], 0
    while low < len(order):
        least = max(1, int(ordered[low]))
        high = int(np.searchsorted(ordered, 2 * least, "right"))
        high = min(high, low + max(1, MATRIX // (2 * least)))
        yield order[low:high]
        low = high


class Words:
    """A column of words in ISO 8859-1."""

    def __init__(self, column: pa.Array):
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.start, self.length = at[:-1], np.diff(at)
        self.data = np.frombuffer(column.buffers()[2], np.uint8) if at[-1] > at[0] else np.zeros(0, np.uint8)

    def letters(self, some: np.ndarray, width: int) -> np.ndarray:
        """A row of letters for each of ``some`` words, zeros behind them."""
        out = np.zeros((len(some), width), np.uint8)
        step = np.arange(width)
        full = step < self.length[some][:, None]
        out[full] = self.data[(self.start[some][:, None] + step)[full]]
        return out

    def matrices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for some in _by_length(self.length):
            length = self.length[some]
            yield some, length, self.letters(some, int(length.max()))


def _grams(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1].astype(np.int32) << 8 | letters[:, 1:]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many places of the vocabulary hold each bigram, by its two letters: 65,536 numbers, most of them 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, length, letters in Words(batch.column(0)).matrices():
                inside = np.arange(letters.shape[1] - 1) < (length - 1)[:, None]
                total += np.bincount(_grams(letters)[inside], minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    out = np.zeros(1 << 16, np.int64)
    for gram, n in words.select("w").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():  # 8,100 at most
        out[gram] = n
    return out


def pivots(rank: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of gram ranks (a large number where there is no gram): which grams are in the prefix, and the places
    of the two disjoint ones among them of least total cost, by dynamic programming along the word."""
    inside = rank <= np.partition(rank, PREFIX - 1, axis=1)[:, PREFIX - 1 : PREFIX]
    far = np.int64(1) << 60
    cost = np.where(inside, cost, far)
    n, width = cost.shape
    one, one_at = np.full(n, far), np.zeros(n, np.int64)  # the best gram that ends before the one at j begins
    two, first, second = np.full(n, 2 * far + 1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(2, width):
        better = cost[:, j - 2] < one
        one, one_at = np.where(better, cost[:, j - 2], one), np.where(better, j - 2, one_at)
        better = one + cost[:, j] < two
        two = np.where(better, one + cost[:, j], two)
        first, second = np.where(better, one_at, first), np.where(better, j, second)
    return inside, first, second


def key_of(rank: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(gram, place, length) as one number: 16 bits of rank, 24 each of place and length, both below 2^24."""
    return (rank.astype(np.int64) << 48) ^ (place.astype(np.int64) << 24) ^ length


ROWS = "key long, asks boolean, last int, w binary, n long"


def index_rows(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """Entries of all prefix grams, and askers of both pivots under every place and length within one edit."""
    order = np.argsort(counts, kind="stable")
    rank_of = np.empty(1 << 16, np.int32)
    rank_of[order] = np.arange(1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, length, letters in Words(batch.column(0)).matrices():
                grams = _grams(letters)
                inside = np.arange(grams.shape[1]) < (length - 1)[:, None]
                rank = np.where(inside, rank_of[grams], 1 << 17)
                prefix, first, second = pivots(rank, counts[grams])
                last = np.where(prefix, rank, 0).max(axis=1)
                row, place = np.nonzero(prefix)
                of = [row]
                keys = [key_of(rank[row, place], place, length[row])]
                every = np.arange(len(some))
                for p in (first, second):
                    r = rank[every, p]
                    # replaced; a letter more behind the gram, before it; a letter less behind it, before it
                    for more, shift in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)):
                        fits = (p + shift >= 0) & (p + shift + 2 <= length + more)
                        keys.append(key_of(r, p + shift, length + more)[fits])
                        of.append(every[fits])
                asks = np.ones(sum(map(len, of)), bool)
                asks[: len(row)] = False
                of = np.concatenate(of)
                taken = pa.array(some[of])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys)), pa.array(asks), pa.array(last[of].astype(np.int32)),
                    batch.column(0).take(taken), batch.column(1).take(taken)], names=["key", "asks", "last", "w", "n"])

    return words.select("w", "n").mapInArrow(run, ROWS)


# ------------------------------------------------------------------------------------ verification

def _parities(letters: np.ndarray) -> np.ndarray:
    """A bit for each of 64 classes of letters, set where their number is odd: an edit turns two at most."""
    out = np.zeros(len(letters), np.uint64)
    for j in range(letters.shape[1]):
        c = letters[:, j]
        out ^= np.where(c > 0, np.uint64(1) << (c & 63).astype(np.uint64), np.uint64(0))
    return out


def one_edit(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """For rows of letters of one width, zeros behind: do the words differ by exactly one edit?"""
    out = (la == lb) & ((a != b).sum(axis=1) == 1)
    for x, y, some in ((a, b, lb == la + 1), (b, a, la == lb + 1)):
        x, y = x[some], y[some]  # y has a letter more; without its first letter that is not in x, it must be x
        front = (x != y).argmax(axis=1)
        out[some] = ((x[:, :-1] == y[:, 1:]) | (np.arange(x.shape[1] - 1) < front[:, None])).all(axis=1)
    return out


def _near(words: Words, asker: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which pairs of places in ``words`` are one edit apart."""
    la, lb = words.length[asker], words.length[entry]
    out = np.zeros(len(asker), bool)
    for some in _by_length(np.maximum(la, lb)):
        width = int(max(la[some].max(), lb[some].max()))
        out[some] = one_edit(words.letters(asker[some], width), words.letters(entry[some], width), la[some], lb[some])
    return out


def _candidates(begin: np.ndarray, split: np.ndarray, end: np.ndarray, last: np.ndarray, parity: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (asker, entry) of cells with entries from ``begin`` and askers from ``split`` to ``end`` that may be near."""
    n_entries, n_askers = split - begin, end - split
    small = n_entries * n_askers < TILE >> 4
    for b, m, e in zip(*(x[~small].tolist() for x in (begin, split, end))):
        rows = max(1, TILE // (m - b))
        for low in range(m, e, rows):
            high = min(e, low + rows)
            close = np.bitwise_count(parity[low:high, None] ^ parity[None, b:m]) <= 2
            close &= last[low:high, None] <= last[None, b:m]
            i, j = np.nonzero(close)
            yield low + i, b + j
    begin, n_entries, split, n_askers = begin[small], n_entries[small], split[small], n_askers[small]
    pairs = np.concatenate([[0], np.cumsum(n_entries * n_askers)])
    low = 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(pairs, pairs[low] + TILE, "right")) - 1)
        cell = np.repeat(np.arange(low, high), np.diff(pairs[low : high + 1]))
        nth = np.arange(len(cell)) + pairs[low] - pairs[cell]
        asker, entry = split[cell] + nth // n_entries[cell], begin[cell] + nth % n_entries[cell]
        close = (np.bitwise_count(parity[asker] ^ parity[entry]) <= 2) & (last[asker] <= last[entry])
        yield asker[close], entry[close]
        low = high


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, cell and, in a cell, entries before askers -> pairs of near words, the smaller one first.
    At most one cell is carried from batch to batch."""
    held: pa.Table | None = None

    def settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        column = rows.column("w").combine_chunks()
        words = Words(column)
        parity = np.zeros(rows.num_rows, np.uint64)
        for some, _, letters in words.matrices():
            parity[some] = _parities(letters)
        last, asks = rows.column("last").to_numpy(), rows.column("asks").to_numpy()
        begin = np.append(_first(rows), rows.num_rows)
        asked = np.concatenate([[0], np.cumsum(asks)])
        end = begin[1:]
        split = end - (asked[end] - asked[begin[:-1]])
        begin = begin[:-1]
        both = (split > begin) & (end > split)
        n = rows.column("n").combine_chunks()
        for asker, entry in _candidates(begin[both], split[both], end[both], last, parity):
            near = _near(words, asker, entry)
            a, b = pa.array(asker[near]), pa.array(entry[near])
            x, y = column.take(a), column.take(b)
            less = pc.less(x, y)
            yield pa.RecordBatch.from_arrays([
                pc.if_else(less, x, y), pc.if_else(less, n.take(a), n.take(b)),
                pc.if_else(less, y, x), pc.if_else(less, n.take(b), n.take(a))], names=["a", "a_n", "b", "b_n"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        tail = int(_first(rows)[-1]) if rows.num_rows else 0
        if tail:
            yield from settled(rows.slice(0, tail))
        held = rows.slice(tail)
    if held is not None and held.num_rows:
        yield from settled(held)


def _first(rows: pa.Table) -> np.ndarray:
    """Where a cell's rows begin."""
    key, cell = rows.column("key").to_numpy(), rows.column("cell").to_numpy()
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    return np.flatnonzero(fresh)


def near_pairs(words: DataFrame, cell: int = CELL) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n``: every pair of words one edit apart, once."""
    counts = gram_counts(words)
    rows = index_rows(words, counts)
    loads = rows.groupBy("key").agg(F.count_if("asks").alias("askers"), F.count_if(~F.col("asks")).alias("entries"))
    live = loads.where("askers > 0 AND entries > 0").select(
        "key", F.ceil(F.col("askers") / cell).cast("int").alias("across"), F.ceil(F.col("entries") / cell).cast("int").alias("down"))
    hot = cut_lineage(live.where("across > 1 OR down > 1"))  # at most a key for every ``cell`` rows

    one = F.lit(1)
    sized = rows.join(hot, "key", "left").withColumns({"across": F.coalesce("across", one), "down": F.coalesce("down", one)})

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("w"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    # an asker goes to its column of cells, an entry to its row of cells
    asker_cells = F.transform(every("down"), lambda j: j * F.col("across") + part("across"))
    entry_cells = F.transform(every("across"), lambda i: part("down") * F.col("across") + i)
    filed = sized.withColumn("cell", F.explode(F.when(F.col("asks"), asker_cells).otherwise(entry_cells))).drop("across", "down")
    met = filed.repartition("key", "cell").sortWithinPartitions("key", "cell", "asks").mapInArrow(
        _meet, "a binary, a_n long, b binary, b_n long")
    return met.distinct()


# ------------------------------------------------------------------------------------ forms

def roots(forms: DataFrame) -> DataFrame:
    """``w``, ``root`` from ``w``, ``form``: pointers jump to their target's target until none moves. Counts at least
    double from word to form, so chains are short and rounds few."""
    labels = cut_lineage(forms.select("w", F.col("form").alias("root")))
    while True:
        ahead = labels.select(F.col("w").alias("root"), F.col("root").alias("next"))
        jumped = cut_lineage(labels.join(ahead, "root", "left").select("w", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        labels = jumped.select("w", "root")
        if jumped.where("moved").isEmpty():
            return labels


def variants(docs: DataFrame, least_n: int = LEAST_N, cell: int = CELL) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of the corpus."""
    words = cut_lineage(vocabulary(docs, least_n))
    pairs = cut_lineage(near_pairs(words, cell))
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("w"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = words.join(best, "w", "left").select(
        "w", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best.near")).alias("form"), (-F.col("best.less")).alias("form_n"))
    told = cut_lineage(told.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n"))))
    ends = roots(told.where("form IS NOT NULL"))

    def text(c: str) -> Column:
        return F.decode(c, "ISO-8859-1").alias(c)

    return told.join(ends, "w", "left").select(
        text("w").alias("word"), text("form"), F.decode(F.coalesce("root", "w"), "ISO-8859-1").alias("root"), "n", "n_near", "form_n")

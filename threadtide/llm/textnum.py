"""Words, lines and rolling hashes of whole Arrow text columns in numpy.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; as those are ASCII, UTF-8 bytes can be cut
without decoding. Hashes are polynomials modulo 2^64 over random byte codes, read off a prefix sum and
multiplied by the inverse power of their start, then mixed: equal runs get equal hashes wherever they stand,
and different runs share one with a chance near 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint8)
IS_SPACE = np.isin(np.arange(256), SPACES)
CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefix:
    """Prefix sums of a sequence of 64-bit codes; gives the hash of any of its runs."""

    def __init__(self, codes: np.ndarray, base: int):
        self.base, n = base, len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(base, n), dtype=np.uint64, out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + length * np.uint64(0xA0761D6478BD642F))

    def windows(self, k: int) -> np.ndarray:
        """The hash of every window of k codes."""
        n = max(0, len(self.sums) - k)
        return mixed((self.sums[k : k + n] - self.sums[:n]) * self.inverse[:n])


class Block:
    """Some neighbouring rows of a text column: bytes, where each row begins, its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        full = ~IS_SPACE[data]
        begins, ends = full.copy(), full.copy()
        begins[1:] &= ~full[:-1]
        ends[:-1] &= ~full[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] = full[inner]
        ends[inner - 1] = full[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each row's words, and the end
        self._bytes: Prefix | None = None

    @property
    def bytes_prefix(self) -> Prefix:
        if self._bytes is None:
            self._bytes = Prefix(CODES[self.data], BYTE_BASE)
        return self._bytes

    def words(self, some: np.ndarray | slice = slice(None)) -> pa.Array:
        """The words as strings, or those that ``some`` picks."""
        starts, ends = self.starts[some], self.ends[some]
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        place = np.arange(at[-1]) + np.repeat(starts - at[:-1], ends - starts)
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(self.data[place]))

    def row_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def word_hashes(self) -> np.ndarray:
        return self.bytes_prefix.runs(self.starts, self.ends)

    def code_points(self) -> np.ndarray:
        """Prefix count of code points."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every line; a row always has one more line than line feeds."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], feeds + 1]), kind="stable")
        ends = np.sort(np.concatenate([feeds, self.offsets[1:]]), kind="stable")
        feeds_before = np.searchsorted(feeds, self.offsets)
        rows = np.repeat(np.arange(self.rows), np.diff(feeds_before) + 1)
        return starts, ends, rows


def blocks(column: pa.Array, most_bytes: int = 1 << 20, table: np.ndarray | None = None) -> Iterator[tuple[int, int, Block]]:
    """Cuts a text column into runs of rows of about ``most_bytes``; a longer text stands alone. NULL is empty.
    ``table`` replaces every byte first, so that other characters than blanks can part words."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most_bytes, "right")) - 1)
        part = data[at[low] : at[high]]
        yield low, high, Block(part if table is None else table[part], at[low : high + 1] - at[low])
        low = high


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, run i from first[i] to first[i+1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key stands at two places or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    place = np.searchsorted(twice, keys)
    place[place == len(twice)] = 0
    return twice[place] == keys


def covered(marks: np.ndarray, k: int, n: int) -> np.ndarray:
    """True for each of n words inside a marked window of k words."""
    out = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(marks)
    out[at] += 1
    np.subtract.at(out, at + k, 1)
    return np.cumsum(out[:n]) > 0

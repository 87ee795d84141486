"""Quality scores by a generalised additive model with pairwise interactions.

Some thirty numbers describe a text: shares of kinds of characters, repeated words, windows and lines, lengths.
Each is cut into at most ``BINS`` bins at quantiles of all documents. The model is a lookup table per number
and a few tables per pair of numbers, added up to a log-odds:

* main tables by cyclic boosting: round after round every number in turn gets a tree of ``LEAVES`` leaves on its bins,
  fitted to what the others leave unexplained, and a small step of it is added to the table;
* pairs by the gain of their best cut into quadrants on the remaining residual; the best ``PAIRS`` are boosted
  the same way with quadrants as leaves, the main tables held fast;
* both end when a fifth of the sample gets no better.

Scoring is a sum of table look-ups for all rows of a batch at once. Texts are read once: their numbers are written,
and bins, sample and scores read those.

The model is fitted in one task on at most ``PER_CLASS`` labelled documents of either class, drawn by a hash of doc_id and
weighted up to their class; the numbers and the bins cover all documents.

Edge cases: a text that is NULL or without words has all numbers 0 and is scored like any other; a NULL doc_id is
not held out and not learnt from; rows that share a doc_id are scored each for itself and give one labelled row (the
smallest numbers); labels of one doc_id are averaged and count as 1 from a half on; NULL labels are left out; without
labels all scores are 0.5, with one class the smoothed share of it; texts of any length are read whole; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtide.llm import textnum as tn
from threadtide.session import cut_lineage

PER_CLASS, BINS, ROUNDS, PATIENCE, RATE, RIDGE = 10_000, 32, 300, 20, 0.1, 1.0
LEAVES, PAIRS, LEAST_WEIGHT = 3, 10, 5.0
CUT = 0.3  # a document is good from this score on
WINDOW = 5
FEATURES = [
    "words", "lines", "words_a_line", "words_a_sentence", "word_length", "word_length_spread", "longest_word", "short_words",
    "upper", "capital_words", "letters", "digits", "exclamations", "symbols", "marks", "odd_marks", "wide", "stretched",
    "symbol_words", "digit_words", "links", "distinct_words", "top_word", "same_as_last", "longest_run", "repeated_windows",
    "repeated_lines", "short_lines",
]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


LOWER, UPPER, DIGIT = _table(bytes(range(97, 123))), _table(bytes(range(65, 91))), _table(b"0123456789")
SYMBOL, MARK, STOP = _table(b"#*$%&|<>"), _table(b".,;:?'\"()-"), _table(b".!?")
ODD = _table(bytes(range(33, 127))) & ~LOWER & ~UPPER & ~DIGIT & ~SYMBOL & ~MARK & ~_table(b"!")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _most(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.maximum.at(out, rows, values)
    return out


def measures(block: tn.Block) -> np.ndarray:
    """The numbers of a block's rows, in the order of ``FEATURES``."""
    data, n = block.data, block.rows
    after = np.concatenate([[False], data[:-1] == 0xC3])  # the second byte of a character from U+00C0 to U+00FF
    upper = UPPER[data] | (after & (data < 0x9F))
    lower = LOWER[data] | (after & (data >= 0x9F))

    def sums(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    def by_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(sums(mask)[block.offsets])

    def by_word(mask: np.ndarray) -> np.ndarray:
        total = sums(mask)
        return total[block.ends] - total[block.starts]

    def of_words(values: np.ndarray) -> np.ndarray:
        return tn.per_row(values, block.first)

    chars = block.code_points()
    length = chars[block.ends] - chars[block.starts]
    row, words = block.row_of_words(), np.diff(block.first)
    ink = np.maximum(of_words(length), 1)
    mean = _ratio(of_words(length), words)
    spread = np.sqrt(np.maximum(_ratio(of_words(length * length), words) - mean**2, 0))

    same = np.zeros(len(data) + 2, bool)
    same[2:-2] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & ~tn.IS_SPACE[data[2:]]
    same[block.offsets] = same[block.offsets + 1] = False  # what stands before a row is another row's
    same = same[: len(data)]

    salt = tn.mixed(np.arange(1, n + 1, dtype=np.uint64))
    hashes = block.word_hashes()
    _, first, often = np.unique(hashes ^ salt[row], return_index=True, return_counts=True)
    last = np.zeros(len(row), bool)
    last[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    begins = np.flatnonzero(~last)
    runs = np.diff(np.append(begins, len(row)))
    windows = tn.Prefix(hashes, tn.WORD_BASE).windows(WINDOW)
    inside = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    marks = np.zeros(len(row), bool)
    marks[inside] = tn.repeated(windows[inside] ^ salt[row[inside]])

    begin, end, line_row = block.lines()
    width = chars[end] - chars[begin]
    full = np.flatnonzero(width)
    again = np.zeros(len(begin), bool)
    again[full] = tn.repeated(block.bytes_prefix.runs(begin[full], end[full]) ^ salt[line_row[full]])
    lines = np.bincount(line_row[full], minlength=n)

    symbols, digits = SYMBOL[data], DIGIT[data]
    link = np.zeros(len(data), bool)
    link[2:] = (data[:-2] == 58) & (data[1:-1] == 47) & (data[2:] == 47)
    link[block.offsets[:-1][block.offsets[:-1] < len(data)]] = False
    link[block.offsets[:-1][block.offsets[:-1] + 1 < len(data)] + 1] = False
    caps = (by_word(upper) >= 2) & (by_word(lower) == 0)
    columns = [
        np.log1p(words), np.log1p(lines), np.log1p(_ratio(words, lines)), np.log1p(_ratio(words, by_row(STOP[data]))),
        mean, spread, np.log1p(_most(length, row, n)), _ratio(of_words(length <= 2), words),
        _ratio(by_row(upper), by_row(upper | lower)), _ratio(of_words(caps), words),
        by_row(upper | lower) / ink, by_row(digits) / ink, _ratio(by_row(data == 33), words), _ratio(by_row(symbols), words),
        _ratio(by_row(MARK[data]), words), _ratio(by_row(ODD[data]), words), by_row(data >= 0xC0) / ink, by_row(same) / ink,
        _ratio(of_words(by_word(symbols) > 0), words), _ratio(of_words(by_word(digits) > 0), words),
        _ratio(by_row(link | (data == 64)), words), _ratio(np.bincount(row[first], minlength=n), words),
        _ratio(_most(often, row[first], n), words), _ratio(of_words(last), words), _ratio(_most(runs, row[begins], n), words),
        _ratio(of_words(tn.covered(marks, WINDOW, len(row))), words),
        _ratio(np.bincount(line_row[again], minlength=n), lines),
        _ratio(np.bincount(line_row[full[width[full] < 20]], minlength=n), lines),
    ]
    return np.stack([c.astype(np.float64) for c in columns], axis=1)


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the numbers of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, block in tn.blocks(batch.column(1)):
                x = measures(block)
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


# ------------------------------------------------------------------------------------ the model

@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    main: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), _sigmoid(np.float64(self.base)))
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.main):
            total += table[bins[:, i]]
        for (i, j), table in self.pairs.items():
            total += table[bins[:, i], bins[:, j]]
        return _sigmoid(total)


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -700, 700)))


def _loss(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float((w * np.logaddexp(0, np.where(y > 0, -s, s))).sum() / w.sum())


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= LEAST_WEIGHT, g * g / (h + RIDGE), -np.inf)


def line_tree(g: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The step per bin of a tree on one number: its best cuts, one after another, into ``LEAVES`` ranges of bins."""
    cuts = [0, len(g)]
    for _ in range(LEAVES - 1):
        best, at = 1e-9, None
        for low, high in zip(cuts[:-1], cuts[1:]):
            if high - low < 2:
                continue
            gl, hl, wl = (np.cumsum(v[low:high])[:-1] for v in (g, h, weight))
            gt, ht, wt = g[low:high].sum(), h[low:high].sum(), weight[low:high].sum()
            fits = (wl >= LEAST_WEIGHT) & (wt - wl >= LEAST_WEIGHT)
            gain = np.where(fits, gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE), -np.inf)
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], low + k + 1
        if at is None:
            break
        cuts = sorted([*cuts, at])
    step = np.zeros(len(g))
    for low, high in zip(cuts[:-1], cuts[1:]):
        step[low:high] = g[low:high].sum() / (h[low:high].sum() + RIDGE)
    return step


def _quadrants(v: np.ndarray) -> list[np.ndarray]:
    """Sums of the four quadrants for every pair of cuts."""
    a = v.cumsum(axis=0).cumsum(axis=1)
    ll, lower, left, whole = a[:-1, :-1], a[:-1, -1:], a[-1:, :-1], a[-1, -1]
    return [ll, lower - ll, left - ll, whole - lower - left + ll]


def square_tree(g: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain of the best cut of two numbers into quadrants, and its step per pair of bins."""
    step = np.zeros(g.shape)
    if min(g.shape) < 2:
        return 0.0, step
    gq, hq, wq = _quadrants(g), _quadrants(h), _quadrants(weight)
    gain = sum(np.where(b > 0, a * a / (b + RIDGE), 0.0) for a, b in zip(gq, hq)) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where(np.minimum.reduce([np.maximum(wq[0], wq[1]), np.maximum(wq[2], wq[3])]) >= LEAST_WEIGHT, gain, 0.0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    for k, (rows, columns) in enumerate([(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                         (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]):
        step[rows, columns] = gq[k][i, j] / (hq[k][i, j] + RIDGE)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, edges: list[np.ndarray], rounds: int = ROUNDS, n_pairs: int = PAIRS) -> Model:
    """The model of rows ``x`` with labels ``y`` and weights ``w``; every fifth row says when to stop."""
    model = Model(edges, 0.0, [np.zeros(len(e) + 1) for e in edges])
    if not len(y):
        return Model([], 0.0, [])
    share = ((w * y).sum() + 1) / (w.sum() + 2)
    model.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Model([], model.base, [])
    w = w * len(w) / w.sum()
    late = np.arange(len(y)) % 5 == 4
    bins = model.bins(x)
    sizes = [len(t) for t in model.main]
    total = np.full(len(y), model.base)

    def sums(at: np.ndarray, n: int) -> list[np.ndarray]:
        p = _sigmoid(total[~late])
        g, h = w[~late] * (y[~late] - p), w[~late] * p * (1 - p)
        return [np.bincount(at[~late], v, n) for v in (g, h, w[~late])]

    def boosted(parts: list, places: list[np.ndarray], trees) -> None:
        """Rounds over all parts in turn, until the late rows get no better; the best state stays."""
        nonlocal total
        best, held, kept, stale = _loss(total[late], y[late], w[late]), [t.copy() for t in parts], total.copy(), 0
        for _ in range(rounds):
            for k, at in enumerate(places):
                step = RATE * trees(k, *sums(at, parts[k].size))
                parts[k] += step.reshape(parts[k].shape)
                total = total + step.ravel()[at]
            loss = _loss(total[late], y[late], w[late])
            if loss < best - 1e-6:
                best, held, kept, stale = loss, [t.copy() for t in parts], total.copy(), 0
            elif (stale := stale + 1) >= PATIENCE:
                break
        for t, old in zip(parts, held):
            t[...] = old
        total = kept

    boosted(model.main, [bins[:, i] for i in range(len(sizes))], lambda k, *v: line_tree(*v))

    gains = {}
    for i, j in combinations(range(len(sizes)), 2):
        at = bins[:, i] * sizes[j] + bins[:, j]
        gains[i, j] = square_tree(*(v.reshape(sizes[i], sizes[j]) for v in sums(at, sizes[i] * sizes[j])))[0]
    chosen = sorted((p for p in gains if gains[p] > 0), key=lambda p: (-gains[p], p))[:n_pairs]
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for i, j in chosen}
    tables = list(model.pairs.values())
    boosted(tables, [bins[:, i] * sizes[j] + bins[:, j] for i, j in chosen],
            lambda k, *v: square_tree(*(a.reshape(tables[k].shape) for a in v))[1])
    return model


# ------------------------------------------------------------------------------------ on Spark

def bin_edges(described_docs: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """The distinct quantiles of each number over all documents."""
    grid = ", ".join(f"{i / bins}D" for i in range(1, bins))
    row = described_docs.agg(*[F.expr(f"percentile_approx(x[{i}], array({grid}), 2000)").alias(f) for i, f in enumerate(FEATURES)]).first()
    # values equal to an edge fall above it; the middle of a spike is cut from both sides
    return [np.unique([v for q in (row[f] or []) for v in (q, np.nextafter(q, np.inf))]) for f in FEATURES]


def trained(described_docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model of the documents with a label that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("y")).where(~held_out())
    rows = cut_lineage(described_docs.where(~held_out()).join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    edges = bin_edges(described_docs)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    share = F.when(F.col("y") == 1, min(1.0, per_class / sizes.get(1, 1))).otherwise(min(1.0, per_class / sizes.get(0, 1)))
    sample = rows.select(draw.alias("draw"), "doc_id", "y", "x").where(F.col("draw") < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(2).to_numpy(), b.column(3).flatten().to_numpy()) for b in batches]
        if not parts:
            return
        y = np.concatenate([p[0] for p in parts]).astype(np.float64)
        x = np.concatenate([p[1] for p in parts]).reshape(len(y), len(FEATURES))
        drawn = np.bincount(y.astype(int), minlength=2)
        w = np.array([sizes.get(k, 0) / max(1, drawn[k]) for k in (0, 1)])[y.astype(int)]
        model = fit(x, y, w, edges)
        out = [(-1, -1, [model.base])] + [(i, -1, t.tolist()) for i, t in enumerate(model.main)]
        out += [(i, j, t.ravel().tolist()) for (i, j), t in model.pairs.items()]
        i, j, table = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(table, pa.list_(pa.float64()))], names=["i", "j", "t"])

    # the sample is bounded, so one task may fit it, in an order that does not change from run to run
    found = sample.repartition(1).sortWithinPartitions("draw", "doc_id").mapInArrow(run, "i int, j int, t array<double>").collect()
    model = Model([], 0.0, [])
    for r in sorted(found, key=lambda r: (r["j"], r["i"])):
        if r["i"] < 0:
            model.base = r["t"][0]
        elif r["j"] < 0:
            model.main.append(np.array(r["t"]))
        else:
            model.pairs[r["i"], r["j"]] = np.array(r["t"]).reshape(len(model.main[r["i"]]), -1)
    model.edges = edges if model.main else []
    return model


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    x = cut_lineage(described(docs))
    model = trained(x, labels, per_class)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = x.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")

"""Substring dedup with suffix automata of reference shards.

A window of ``WINDOW`` words is filed under the smallest hash among its ``GRAM``-word grams. Neighbouring windows
with one key form a run, and equal windows have equal keys, so each key is a reference shard of its own: the
automaton of the distinct runs under a key tells, as the runs are streamed through it, how often the last
``WINDOW`` words occur anywhere in the corpus. Automata of the whole corpus would have to meet every document;
these meet only documents that share a gram, and none is larger than ``LIGHT`` runs.

Keys that stand alone in the corpus are left out before any text moves. If all runs of a key are the same run,
every window repeats and no automaton is needed. A key with more distinct runs than ``LIGHT`` (a phrase in very
many contexts) is split to the end: its windows are counted by their own hash. Runs refer to texts by a 128-bit
digest, so equal texts share their spans.

Edge cases: a NULL text has no words; texts shorter than a window keep all words; repeated rows are documents of
their own, so all windows of a repeated text repeat; texts of any length are whole (a run has at most ``RUN``
windows); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadtide.llm import textnum as tn
from threadtide.llm.lines import digest
from threadtide.session import cut_lineage

WINDOW, GRAM, RUN, LIGHT = 35, 12, 64, 256
#: Text digests up to this many are broadcast to pick the texts that are needed; beyond it all texts are shuffled.
BROADCAST_TEXTS = 1_000_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def _runs(window: int, gram: int):
    names = ["text_key", "start", "n_win", "min_hash", "seg_hash", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, block in tn.blocks(batch.column(1)):
                row, words = block.row_of_words(), tn.Prefix(block.word_hashes(), tn.WORD_BASE)
                if len(row) < window:
                    continue
                grams = words.windows(gram)
                least = _sliding_min(grams, window - gram + 1)
                at = np.flatnonzero(row[: len(least)] == row[window - 1 :])
                if not len(at):
                    continue
                key, of = least[at], row[at]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
                begin = np.flatnonzero(new)
                nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                begin = np.flatnonzero(nth % RUN == 0)
                n_win = np.diff(np.append(begin, len(at)))
                start, key, of = at[begin], key[begin], of[begin]
                # a gram that its text holds twice may make a window repeat inside a single run
                salt = tn.mixed(np.arange(block.rows, dtype=np.uint64) + np.uint64(1))
                inside = np.flatnonzero(row[: len(grams)] == row[gram - 1 :])
                salted = np.sort(grams[inside] ^ salt[row[inside]])
                twice = salted[1:][salted[1:] == salted[:-1]]
                place = np.searchsorted(twice, key ^ salt[of])
                again = (np.append(twice, 0)[place] == (key ^ salt[of])) & (place < len(twice))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(low + of)),
                        pa.array((start - block.first[of]).astype(np.int32)),
                        pa.array(n_win.astype(np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.array(words.runs(start, start + n_win + window - 1).view(np.int64)),
                        pa.array(np.where(again, 2, 1).astype(np.int32)),
                    ],
                    names=names,
                )

    return run, "text_key binary, start int, n_win int, min_hash long, seg_hash long, weight int"


class Automaton:
    """Suffix automaton of several weighted sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.seen = [-1], [0], [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.seen.append(0)
        return len(self.length) - 1

    def _split(self, last: int, c: int, q: int) -> int:
        """The state of ``last`` + c alone, taken out of q, which also stands for longer strings."""
        own = self._state(self.length[last] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = own
        while last >= 0 and self.next[last].get(c) == q:
            self.next[last][c] = own
            last = self.link[last]
        return own

    def add(self, sequence: list[int], weight: int) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
            else:
                own, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = own
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[own] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                last = own
            self.seen[last] += weight

    def close(self) -> None:
        """Adds up occurrences from long strings to their suffixes."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.seen[self.link[v]] += self.seen[v]

    def repeats(self, sequence: list[int], window: int) -> list[int]:
        """Starts of the windows of a sequence that occur twice or more."""
        v, out = 0, []
        for end, c in enumerate(sequence, 1):
            v = self.next[v][c]
            while self.length[self.link[v]] >= window:
                v = self.link[v]
            if end >= window and self.seen[v] > 1:
                out.append(end - window)
        return out


def _spans(starts: list[int]) -> list[tuple[int, int]]:
    """First and last of every stretch of consecutive numbers."""
    out: list[list[int]] = []
    for s in starts:
        if out and out[-1][1] == s - 1:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [(a, b) for a, b in out]


def _streamed(window: int):
    """Rows sorted by key and run: the spans of repeated windows in each run, from one automaton per key."""

    def close(key: int, own: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, int]]:
        automaton, words = Automaton(), [np.frombuffer(w, np.int64).tolist() for _, _, w in own]
        for (_, m, _), w in zip(own, words):
            automaton.add(w, m)
        automaton.close()
        return [(key, s, a, b) for (s, _, _), w in zip(own, words) for a, b in _spans(automaton.repeats(w, window))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            out = []
            for k, s, m, w in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if own:
                        out += close(key, own)
                    key, own = k, []
                if not own or own[-1][0] != s:
                    own.append((s, m, w))
            yield _batch(out)
        if own:
            yield _batch(close(key, own))

    def _batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.int32()])],
            names=["min_hash", "seg_hash", "a", "b"],
        )

    return run


def _contents(window: int):
    """From (text_key, text, wanted runs) to the words of each run; neighbouring rows of one text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys, wanted = batch.column(0).to_pylist(), batch.column(2)
            for low, high, block in tn.blocks(batch.column(1)):
                hashes = block.word_hashes().view(np.int64)
                out = []
                for i in range(low, high):
                    if keys[i] == last:
                        continue
                    last = keys[i]
                    at = block.first[i - low]
                    for r in wanted[i].as_py():
                        words = hashes[at + r["start"] : at + r["start"] + r["n_win"] + window - 1]
                        out.append((r["min_hash"], r["seg_hash"], r["m"], words.tobytes(), r["heavy"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[i] for r in out], t)
                        for i, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()])
                    ],
                    names=["min_hash", "seg_hash", "m", "words", "heavy"],
                )

    return run, "min_hash long, seg_hash long, m long, words binary, heavy boolean"


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, s, m, w in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h = tn.Prefix(np.frombuffer(w, np.uint64), tn.WORD_BASE).windows(window).view(np.int64)
                n = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k)), pa.array(np.full(n, s)), pa.array(np.full(n, m)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h)],
                    names=["min_hash", "seg_hash", "m", "a", "h"],
                )

    return run, "min_hash long, seg_hash long, m long, a int, h long"


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, light: int = LIGHT) -> DataFrame:
    """``text_key`` and ``spans``, the word ranges [from, to) that repeated windows cover."""
    keyed = docs.select(digest(F.col("text")).alias("text_key"), "text").where("text IS NOT NULL")
    runs = cut_lineage(keyed.mapInArrow(*_runs(window, gram)))
    shared = (
        runs.groupBy("min_hash")
        .agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.min("seg_hash").alias("low"), F.max("seg_hash").alias("high"))
        .where("w > 1")
        .select("min_hash", F.expr("low = high AND n > 1").alias("uniform"))
    )
    met = cut_lineage(runs.join(shared, "min_hash").drop("weight"))
    mixed = met.where("NOT uniform")
    segments = mixed.groupBy("min_hash", "seg_hash").agg(
        F.count("*").alias("m"), F.min(F.struct("text_key", "start", "n_win")).alias("at")
    )
    segments = cut_lineage(segments)
    crowds = segments.groupBy("min_hash").agg((F.count("*") > light).alias("heavy"))
    wanted = cut_lineage(
        segments.join(crowds, "min_hash")
        .groupBy(F.col("at.text_key").alias("text_key"))
        .agg(F.collect_list(F.struct("at.start", "at.n_win", "min_hash", "seg_hash", "m", "heavy")).alias("wanted"))
    )
    texts = keyed
    if wanted.count() <= BROADCAST_TEXTS:
        texts = texts.join(F.broadcast(wanted.select("text_key")), "text_key", "left_semi")
    contents = cut_lineage(
        texts.join(wanted.hint("merge"), "text_key").select("text_key", "text", "wanted").mapInArrow(*_contents(window))
    )
    by_automaton = (
        contents.where("NOT heavy")
        .select("min_hash", "seg_hash", "m", "words")
        .repartition("min_hash")
        .sortWithinPartitions("min_hash", "seg_hash")
        .mapInArrow(_streamed(window), "min_hash long, seg_hash long, a int, b int")
    )
    split = contents.where("heavy").dropDuplicates(["min_hash", "seg_hash"]).mapInArrow(*_windows(window))
    often = split.groupBy("h").agg(F.sum("m").alias("all")).where(F.col("all") > 1).select("h")
    by_window = split.join(often, "h").select("min_hash", "seg_hash", "a", F.col("a").alias("b"))
    # one row per run carries all its spans, so the join makes no more rows than there are runs in texts
    found = cut_lineage(
        by_automaton.unionByName(by_window).groupBy("min_hash", "seg_hash").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    )
    inner = mixed.join(found, ["min_hash", "seg_hash"]).select(
        "text_key",
        F.transform("found", lambda f: F.struct((F.col("start") + f["a"]).alias("from"), (F.col("start") + f["b"] + window).alias("to"))).alias("spans"),
    )
    end = F.col("start") + F.col("n_win") + window - 1
    whole = met.where("uniform").select("text_key", F.array(F.struct(F.col("start").alias("from"), end.alias("to"))).alias("spans"))
    return inner.unionByName(whole).groupBy("text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, light: int = LIGHT) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the ``text`` of the kept words, joined by one blank."""
    spans = repeated_spans(docs, window, gram, light)
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text", digest(F.col("text")).alias("text_key")).join(spans, "text_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(2)
            for low, high, block in tn.blocks(batch.column(1)):
                n = len(block.starts)
                drop = np.zeros(n + 1, np.int64)
                for i in np.flatnonzero(every[low:high].is_valid().to_numpy(zero_copy_only=False)):
                    for s in every[low + int(i)].as_py():
                        drop[block.first[i] + s["from"]] += 1
                        drop[block.first[i] + s["to"]] -= 1
                stay = np.cumsum(drop[:n]) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high],
                        pa.array(np.diff(block.first)),
                        pa.array(tn.per_row(~stay, block.first)),
                        pa.array(_joined(block, stay), pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "text"],
                )

    return joined.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, text string")


def _joined(block: tn.Block, stay: np.ndarray) -> list[str]:
    """Each row's kept words with one blank between them."""
    edges = np.zeros(len(block.data) + 1, np.int64)
    edges[block.starts[stay]] += 1
    edges[block.ends[stay]] -= 1
    keep = np.cumsum(edges[:-1]) > 0
    rows = block.row_of_words()[stay]
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    data = block.data.copy()
    blanks = block.ends[stay][~last]
    data[blanks] = 32
    keep[blanks] = True
    place = np.concatenate([[0], np.cumsum(keep)])[block.offsets]
    text = data[keep].tobytes()
    return [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip(place[:-1].tolist(), place[1:].tolist())]

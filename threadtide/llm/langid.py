"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of other characters than letters becomes one blank, and character n-grams of one
to three are hashed into 2^16 features. A feature weighs its share of the text's n-grams times its inverse
document frequency, which is counted over all documents that may be learnt from. The model is fitted by
follow-the-regularised-leader with elastic-net penalties on a sample of at most about ``PER_LANGUAGE`` documents
of each language, drawn by a hash of doc_id; a fifth of the sample sets the temperature that the scores are
divided by. Prediction reads the text alone.

Edge cases: a text that is NULL or has no letter is ``und`` with score 0; if nothing can be learnt from, all are;
a NULL language or doc_id is not learnt from, and a NULL doc_id is not held out; texts of any length are read
whole; repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtide.llm import textnum as tn
from threadtide.session import cut_lineage

DIM, GRAMS = 1 << 16, (1, 2, 3)
PER_LANGUAGE, EPOCHS = 500, 3
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 1e-3, 1e-4, 10.0
BLOCK_BYTES = 1 << 18
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of all texts one after another, and where each text's begin (one more than texts)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    lowered = [t.lower() for t in texts]
    np.cumsum([len(t) for t in lowered], out=bounds[1:])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])  # the first other character after a letter is the blank
    codes, row = np.where(letter, codes, 32)[keep].astype(np.uint32), row[keep]
    has = np.zeros(len(texts), bool)
    has[row[codes != 32]] = True
    grams, rows = [], []
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : i + m]) * MULTIPLIERS[i]
            h ^= h >> np.uint32(15)
        inside = (row[:m] == row[n - 1 :]) & has[row[:m]]
        grams.append((h[inside] * MULTIPLIERS[0] >> np.uint32(16)).astype(np.uint16))
        rows.append(row[:m][inside])
    if not grams:
        return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
    if len(texts) == 1:
        hashed = np.concatenate(grams)
        return hashed, np.array([0, len(hashed)])
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return np.concatenate(grams)[order], np.searchsorted(rows[order], np.arange(len(texts) + 1))


def _text_blocks(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))])
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + BLOCK_BYTES, "right")) - 1)
        yield low, high, [t or "" for t in column[low:high].to_pylist()]
        low = high


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # feature x language, with the inverse document frequency multiplied in
    temperature: float


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``feature``, ``df`` over all rows of ``text``; a task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, _, part in _text_blocks(batch.column(0)):
                hashed, at = features(part)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    if b > a:
                        n += 1
                        total += np.bincount(hashed[a:b], minlength=DIM) > 0
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(full, -1)), pa.array(np.append(total[full], n))], names=["feature", "df"]
        )

    parts = texts.select("text").mapInArrow(run, "feature long, df long")
    return parts.groupBy("feature").agg(F.sum("df").alias("df"))


def _sparse(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashed, _ = features([text])
    at, n = np.unique(hashed, return_counts=True)
    return at, (SCALE * idf[at] * n / max(1, len(hashed))).astype(np.float32)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int) -> np.ndarray:
    """Follow-the-regularised-leader, per coordinate, over (features, values, class) in the given order."""
    z, n = np.zeros((DIM, n_classes)), np.zeros((DIM, n_classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for at, x, label in rows:
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the labels most likely; golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(scores / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, ratio = -5.0, 5.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from rows with a language that are not held out. ``per_language`` bounds the fitted sample."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    spark = docs.sparkSession
    counts = {r["feature"]: r["df"] for r in document_frequencies(known).collect()}  # at most DIM + 1 rows
    per_lang = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per_lang)
    if not languages:
        return Model([], np.zeros((DIM, 0)), 1.0)
    n_docs = counts.pop(-1, 0)
    idf = np.full(DIM, np.log(1.0 + n_docs))
    at = np.fromiter(counts.keys(), np.int64, len(counts))
    idf[at] = np.log((1.0 + n_docs) / (1.0 + np.fromiter(counts.values(), np.int64, len(counts)))) + 1e-3
    share = F.create_map(*[x for k, n in per_lang.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    sample = cut_lineage(known.where(draw < share[F.col("lang")]).select(draw.alias("draw"), "doc_id", "lang", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, later = [], []
        for batch in batches:
            for i, (lang, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                at, x = _sparse(text, idf)
                if len(at):
                    (later if (len(rows) + len(later)) % 5 == 4 else rows).append((at, x, languages.index(lang)))
        w = train(rows, len(languages))
        scores = np.array([x @ w[at] for at, x, _ in later]).reshape(len(later), len(languages))
        t = temperature(scores, np.array([c for _, _, c in later], np.int64))
        full = np.flatnonzero(w.any(axis=1))
        values = [[t] * len(languages), *w[full].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1], full])), pa.array(values, pa.list_(pa.float64()))], names=["feature", "w"]
        )

    # the sample is bounded, so one task may fit it, in an order that does not change from run to run
    model = sample.repartition(1).sortWithinPartitions("draw", "doc_id").mapInArrow(run, "feature long, w array<double>")
    weights, heat = np.zeros((DIM, len(languages))), 1.0
    for r in model.collect():  # at most DIM + 1 rows
        if r["feature"] < 0:
            heat = r["w"][0]
        else:
            weights[r["feature"]] = r["w"]
    return Model(languages, (SCALE * idf[:, None] * weights).astype(np.float32), heat)


def identify(docs: DataFrame, model: Model, carry: Column | None = None) -> DataFrame:
    """Every row as ``row`` (``carry``, by default its doc_id), ``held_out``, ``lang_pred``, ``score``."""
    asked = docs.select((F.col("doc_id") if carry is None else carry).alias("row"), held_out().alias("held_out"), "text")
    schema = f"row {asked.schema['row'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    names = [*model.languages, "und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            for low, high, part in _text_blocks(batch.column(2)) if model.languages else ():
                hashed, at = features(part)
                full = np.flatnonzero(at[1:] > at[:-1])
                if len(full):
                    total = np.add.reduceat(model.weights[hashed], at[full], axis=0, dtype=np.float64)
                    p = _softmax(total / (at[full + 1] - at[full])[:, None] / model.temperature)
                    best[low + full] = p.argmax(axis=1)
                    score[low + full] = p.max(axis=1)
            labels = pa.array(names).take(pa.array(best))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), labels, pa.array(np.minimum(score, 1.0))], names=["row", "held_out", "lang_pred", "score"]
            )

    return asked.mapInArrow(run, schema)

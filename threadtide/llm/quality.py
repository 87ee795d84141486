"""Quality rules on repetition: characters inside duplicated word n-grams and duplicated lines.

Every text is hashed once; n-grams of all lengths are read off the same prefix sums, so the work grows with
the text only. There is no shuffle.

Edge cases: a NULL or empty text has no words, fails the base rule and is not kept; texts of any length are
handled whole (a batch is cut into blocks of about one megabyte, a longer text is its own block); repeated
rows are judged alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadtide.llm import textnum as tn

#: Largest allowed share of the characters in words that stand in duplicated n-grams, by n.
GRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Largest allowed share of the characters in words that stand on repeats of an earlier line.
LINE_CHARS_LIMIT = 0.30
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _measures(block: tn.Block, grams: tuple[int, ...]) -> dict[str, np.ndarray]:
    n_words = np.diff(block.first)
    points = block.code_points()
    chars = points[block.ends] - points[block.starts]
    word_chars = tn.per_row(chars, block.first)
    rows = block.row_of_words()
    salt = tn.mixed(np.arange(block.rows, dtype=np.uint64) + np.uint64(1))
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": tn.per_row(IS_SYMBOL[block.data], block.offsets)}

    starts, ends, line_row = block.lines()
    begin, stop = np.searchsorted(block.starts, starts), np.searchsorted(block.starts, ends)
    full = np.flatnonzero(stop > begin)
    keys = block.bytes_prefix.runs(starts[full], ends[full]) ^ salt[line_row[full]]
    again = full[tn.repeated(keys)]
    if len(again):
        _, firsts = np.unique(keys[np.searchsorted(full, again)], return_index=True)
        again = np.delete(again, firsts)
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=block.rows)
    chars_to = np.concatenate([[0], np.cumsum(chars)])
    out["dup_line_chars"] = np.bincount(
        line_row[again], weights=chars_to[stop[again]] - chars_to[begin[again]], minlength=block.rows
    ).astype(np.int64)

    words = tn.Prefix(block.word_hashes(), tn.WORD_BASE)
    total = len(rows)
    for k in sorted({*grams, WINDOW}):
        hashes = words.windows(k)
        inside = rows[: len(hashes)] == rows[k - 1 :] if len(hashes) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        marks = np.zeros(total, bool)
        marks[at] = tn.repeated(hashes[at] ^ salt[rows[at]])
        hit = tn.covered(marks, k, total)
        if k == WINDOW:
            out["n_repeat_words"] = tn.per_row(hit, block.first)
        out[f"dup_chars_{k}"] = tn.per_row(np.where(hit, chars, 0), block.first)
    return out


def repetition_rules(
    docs: DataFrame, grams: dict[int, float] | None = None, line_chars: float = LINE_CHARS_LIMIT
) -> DataFrame:
    """One row per document: counts, characters in duplicated n-grams (``dup_chars_<n>``) and on repeated lines
    (``dup_line_chars``), ``base_failed`` and ``kept``."""
    grams = GRAM_LIMITS if grams is None else grams
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names += [f"dup_chars_{k}" for k in sorted(grams)] + ["dup_line_chars"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, block in tn.blocks(batch.column(1)):
                m = _measures(block, tuple(grams))
                words = m["n_words"]
                failed = (words < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * words)
                chars = np.maximum(m["word_chars"], 1)
                bad = m["dup_line_chars"] > line_chars * chars
                for k, limit in grams.items():
                    bad |= m[f"dup_chars_{k}"] > limit * chars
                columns = [batch.column(0)[low:high], *[pa.array(m[n].astype(np.int64)) for n in names]]
                columns += [pa.array(failed), pa.array(~failed & ~bad)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)

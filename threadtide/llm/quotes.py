"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` at its start; neighbouring lines of one level are a passage. Passages
are normalised (lower case, single blanks) and hashed whole, by paragraph and by line, and joined to the hashes of
what messages say themselves. A passage is linked to the first message before it that says it, in its own
conversation if there is one, else anywhere. A message answers what its outermost, longest linked passage comes
from; without one it answers the message before it. Answers make trees; each tree is a conversation, ordered by
depth and then by first order, so that every message stands after the one it answers. Quotes and the lines that
announce them are left out.

Originals are folded to one row per hash before any join, so a line that a third of all messages share is one row.
Roots and depths come from pointer doubling.

Edge cases: a NULL or empty text says nothing and quotes nothing; a message with a NULL conversation or turn
answers only what it quotes; repeated rows are messages of their own; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadtide.operators.ranks import global_row_number
from threadtide.session import cut_lineage

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
ANNOUNCES = re.compile(r"[^\n]{0,200}\b(?:wrote|writes|said|schrieb|escribió|a écrit)[^\n]{0,40}:[ \t]*$")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _normal(text: str) -> str:
    return " ".join(text.lower().split())


def split_levels(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text and its quoted passages as (level, text)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        marks = MARKS.match(line)
        level = marks[1].count(">") if marks else 0
        if level:
            if level != last:
                if last == 0 and own and ANNOUNCES.match(own[-1]):
                    own.pop()
                passages.append((level, []))
            passages[-1][1].append(line[marks.end() :])
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in passages]


def units(text: str) -> dict[int, int]:
    """Hashes of a text, its paragraphs and its lines, with their lengths."""
    parts = {_normal(p) for p in [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]}
    return {_hash(p): len(p) for p in parts if p}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64()), ("chars", pa.int32())]))
    for batch in batches:
        bodies, says, quoted = [], [], []
        for text in batch.column(3).to_pylist():
            own, passages = split_levels(text or "")
            bodies.append(own)
            says.append(list(units(own)))
            quoted.append([{"level": k, "h": h, "chars": n} for k, p in passages for h, n in units(p).items()])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(bodies), pa.array(says, pa.list_(pa.int64())), pa.array(quoted, quote)],
            names=["conv_id", "turn", "role", "content", "says", "quoted"],
        )


def roots(parents: DataFrame) -> DataFrame:
    """``n``, ``root``, ``depth`` from (n, parent); a parent is smaller than its child, or NULL."""
    state = cut_lineage(
        parents.select(
            "n", F.coalesce("parent", "n").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth")
        )
    )
    while True:
        above = state.select(F.col("n").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        jumped = cut_lineage(state.join(above, "root").select("n", F.col("up").alias("root"), F.col("depth") + F.col("more"), F.col("more").alias("left")).toDF("n", "root", "depth", "left"))
        state = jumped.drop("left")
        if jumped.where("left > 0").isEmpty():
            return state


def reply_ordered(messages: DataFrame) -> DataFrame:
    """``thread`` and ``position``, ``conv_id``, ``turn``, ``role``, ``content`` without quotes, ``answers_conv`` and
    ``answers_turn`` of the message it answers, ``linked`` (by a quote) and ``n_links`` (quoted passages found)."""
    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    schema += ", content string, says array<long>, quoted array<struct<level: int, h: long, chars: int>>"
    parsed = messages.select("conv_id", "turn", "role", "text").mapInArrow(_parsed, schema)
    rows = global_row_number(parsed, [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("content", "quoted")], "n").drop("n_total")

    said = rows.select("n", "conv_id", F.explode("says").alias("h"))
    anywhere = said.groupBy("h").agg(F.min("n").alias("first_any"))
    here = said.where("conv_id IS NOT NULL").groupBy("h", "conv_id").agg(F.min("n").alias("first_here"))
    asked = rows.select("n", "conv_id", F.explode("quoted").alias("q")).select("n", "conv_id", "q.level", "q.h", "q.chars")
    found = (
        asked.join(here, ["h", "conv_id"], "left")
        .join(anywhere, "h", "left")
        .withColumn("of", F.when(F.col("first_here") < F.col("n"), F.col("first_here")).when(F.col("first_any") < F.col("n"), F.col("first_any")))
        .where("of IS NOT NULL")
        .groupBy("n")
        .agg(F.max(F.struct(-F.col("level"), "chars", -F.col("of")))["col3"].alias("minus"), F.count("*").alias("n_links"))
        .select("n", (-F.col("minus")).alias("quoted_n"), "n_links")
    )
    place = rows.select("n", "conv_id", "turn")
    previous = place.where("turn IS NOT NULL").select((F.col("n") + 1).alias("n"), F.col("conv_id").alias("before_conv"))
    parents = cut_lineage(
        place.join(previous, "n", "left")
        .join(found, "n", "left")
        .select(
            "n",
            F.coalesce("quoted_n", F.when((F.col("before_conv") == F.col("conv_id")) & F.col("turn").isNotNull(), F.col("n") - 1)).alias("parent"),
            F.col("quoted_n").isNotNull().alias("linked"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
    ordered = global_row_number(roots(parents.select("n", "parent")), [F.col("root"), F.col("depth"), F.col("n")], "at")
    firsts = ordered.where("n = root").select("root", F.col("at").alias("first_at"))
    answered = place.select(F.col("n").alias("parent"), F.col("conv_id").alias("answers_conv"), F.col("turn").alias("answers_turn"))
    return (
        rows.drop("says", "quoted")
        .join(parents, "n")
        .join(ordered.select("n", "root", "at"), "n")
        .join(firsts, "root")
        .join(answered, "parent", "left")
        .select(
            F.col("root").alias("thread"), (F.col("at") - F.col("first_at")).alias("position"),
            "conv_id", "turn", "role", "content", "answers_conv", "answers_turn", "linked", "n_links",
        )
    )

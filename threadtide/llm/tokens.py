"""Training-order materialisation: token ids in fixed-stride binary shards, in a keyed random order.

Texts are tokenised and laid end to end, each closed by an end token, and cut into sequences of ``LENGTH`` ids;
only the last sequence of a task is filled up. A written stage holds them with their task and place, so a
sequence's number is its task's offset plus its place. A keyed Feistel network over the next even power of two,
walked on while it leaves 0..N-1, gives each number a slot of its own. Sequences then move once, by ranges of
shards, and every shard is one file of ``SHARD_ROWS`` records: the ids as little-endian numbers and a line feed,
so record k of a shard begins at k times the stride and a reader can stop and go on at any slot.

The vocabulary is a rank file of a public byte-level tokenizer, read through Spark and of bounded size.

Edge cases: a NULL or empty text is its end token alone; texts of any length are whole; repeated rows are
sequences of their own; other columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadtide.llm.textnum import mixed
from threadtide.session import cut_lineage, fresh_path

LENGTH, SHARD_ROWS, KEY, ROUNDS, SLICE_ROWS = 2048, 1024, 20240607, 6, 128
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_VOCABULARY_BYTES = 64 << 20
PACK_LEVEL, DICTIONARY_TEXTS, DICTIONARY_BYTES = 9, 200, 1 << 17


@dataclass(frozen=True)
class Vocabulary:
    ranks: dict[bytes, int]
    pattern: str = PATTERN

    @property
    def end(self) -> int:
        """The end token: the first id after the ranks."""
        return len(self.ranks)

    @property
    def kind(self) -> str:
        return "<u2" if self.end < 1 << 16 else "<u4"

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Vocabulary:
    rows = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("length", "content")
    row = rows.where(F.col("length") <= MOST_VOCABULARY_BYTES).first()
    if row is None:
        raise ValueError("no vocabulary of a bounded size at that path")
    pairs = (line.split() for line in bytes(row["content"]).splitlines() if line)
    return Vocabulary({base64.b64decode(word): int(rank) for word, rank in pairs})


class Packing:
    """Compression of the ids of one sequence against a dictionary of ids that every task holds."""

    def __init__(self, dictionary: bytes):
        own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=PACK_LEVEL, dict_data=own).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=own).decompress


def dictionary(docs: DataFrame, vocabulary: Vocabulary) -> bytes:
    """Ids of the beginnings of a few texts. It only makes packed sequences smaller while they are moved; what is
    written does not depend on it."""
    some = docs.where("text IS NOT NULL").select(F.substring("text", 1, 4096).alias("text")).limit(DICTIONARY_TEXTS)
    encode = vocabulary.encoding().encode_ordinary
    ids = [i for r in some.collect() for i in encode(r["text"])]
    return np.array(ids, vocabulary.kind).tobytes()[:DICTIONARY_BYTES]


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def sequences(docs: DataFrame, vocabulary: Vocabulary, length: int = LENGTH, shared: bytes = b"") -> DataFrame:
    """``task``, ``nth`` in the task, ``body`` (packed ids), ``n_tokens``, ``docs``: which tokens of which document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    part = f"array<struct<doc_id: {id_type}, from: long, at: int, n: int>>"
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, pack = held.value[0], Packing(held.value[1]).pack
        encode, task, nth = v.encoding().encode_ordinary, TaskContext.get().partitionId(), 0
        ids, n, parts = [], 0, []

        def batch_of(rows: list[tuple], docs_type: pa.DataType) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), docs_type]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["task", "nth", "body", "n_tokens", "docs"]
            )

        kind, out = None, []
        for batch in batches:
            kind = pa.list_(pa.struct([("doc_id", batch.column(0).type), ("from", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))
            for doc_id, text in (pair for low in range(0, batch.num_rows, SLICE_ROWS) for pair in _pairs(batch.slice(low, SLICE_ROWS))):
                own = np.array([*encode(text or ""), v.end], v.kind)
                at = 0
                while at < len(own):
                    take = min(length - n, len(own) - at)
                    ids.append(own[at : at + take])
                    parts.append({"doc_id": doc_id, "from": at, "at": n, "n": take})
                    at, n = at + take, n + take
                    if n == length:
                        out.append((task, nth, pack(np.concatenate(ids).tobytes()), n, parts))
                        ids, n, parts, nth = [], 0, [], nth + 1
                    if len(out) == SLICE_ROWS:
                        yield batch_of(out, kind)
                        out = []
        if out:
            yield batch_of(out, kind)
        if n:
            filled = np.concatenate([*ids, np.full(length - n, v.end, v.kind)])
            yield batch_of([(task, nth, pack(filled.tobytes()), n, parts)], kind)

    return docs.select("doc_id", "text").mapInArrow(run, f"task long, nth long, body binary, n_tokens int, docs {part}")


def feistel(numbers: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0..count-1: a balanced network on an even number of bits, walked until inside."""
    half = max(1, -(-max(count - 1, 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= count]
    return out.astype(np.int64)


def slot_of(number: Column, count: int, key: int = KEY) -> Column:
    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), count, key))

    return permuted(number)


def write_training_order(
    docs: DataFrame, vocabulary: Vocabulary, path: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY
) -> DataFrame:
    """Writes the shards below ``path`` as shard=<k>/part-... and returns their index: ``slot``, ``shard``,
    ``offset`` (bytes into the shard), ``n_tokens``, ``docs``."""
    shared = dictionary(docs, vocabulary)
    made = cut_lineage(sequences(docs, vocabulary, length, shared))
    sizes = made.groupBy("task").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))  # one row a task
    count = made.count()
    width = np.dtype(vocabulary.kind).itemsize
    stride = length * width + 1
    slotted = (
        made.join(F.broadcast(offsets), "task")
        .withColumn("slot", slot_of(F.col("before") + F.col("nth"), count, key))
        .withColumn("shard", F.floor(F.col("slot") / shard_rows))
    )

    held = docs.sparkSession.sparkContext.broadcast(shared)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Packing(held.value).unpack
        for batch in batches:
            for part in (batch.slice(low, SLICE_ROWS) for low in range(0, batch.num_rows, SLICE_ROWS)):
                bodies = pa.array([unpack(b) for b in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bodies], names=["shard", "slot", "body"])

    moved = slotted.select("shard", "slot", "body").repartitionByRange("shard")
    records = moved.mapInArrow(raw, "shard long, slot long, body binary").sortWithinPartitions("shard", "slot")
    # the text writer puts the bytes out as they are
    records.select("shard", F.col("body").cast("string").alias("value"), "slot").drop("slot").write.partitionBy("shard").text(path)
    return slotted.select("slot", "shard", (F.col("slot") % shard_rows * stride).alias("offset"), "n_tokens", "docs")


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, kind: str = "<u2") -> DataFrame:
    """``shard``, ``nth``, ``ids`` of every record below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = length * np.dtype(kind).itemsize + 1
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = np.frombuffer(content, np.uint8).reshape(-1, stride)[:, :-1]
                ids = np.ascontiguousarray(table).view(kind).astype(np.int32)
                shard = int(name.split("/shard=")[1].split("/")[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), shard)), pa.array(np.arange(len(ids))), pa.array(list(ids), pa.list_(pa.int32()))],
                    names=["shard", "nth", "ids"],
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, "shard long, nth long, ids array<int>")


def training_order(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """One row per stretch of a document in a sequence, after the shards are written to the shared folder."""
    spark = docs.sparkSession
    index = write_training_order(docs, read_vocabulary(spark, vocabulary_path), fresh_path(spark, "shards"))
    part = F.explode("docs").alias("part")
    return index.select("slot", "shard", "offset", "n_tokens", part).select(
        F.col("part.doc_id").alias("doc_id"),
        "slot",
        "shard",
        "offset",
        "n_tokens",
        F.col("part.at").alias("seq_from"),
        F.col("part.from").alias("doc_from"),
        F.col("part.n").alias("n_doc_tokens"),
    )

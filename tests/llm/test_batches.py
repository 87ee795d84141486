"""What a task of the pipeline holds at once: bounded Arrow batches, small blocks of text and of sequences."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from threadtide.llm import decontam
from threadtide.llm import textnum as tn


def test_stages_hand_out_small_batches(spark):
    own = spark.newSession()
    docs = own.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 400).alias("text"))
    corpus_pipeline.STAGES[1][1](own, docs.limit(1), "")  # any stage will do

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    got = docs.mapInArrow(sizes, "n long, bytes long").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes")).first()
    assert got["n"] == 6000 and got["bytes"] < 3 << 20


def test_decontamination_holds_little():
    """Blocks of 1 MB took 59 MB on real texts, at 256 KB they take 14."""
    texts = pa.array(["some words of a text that says nothing " * 20] * 4000)
    index = decontam.Index([(1, np.arange(9, dtype=np.uint64))])
    tn._powers.clear()
    tracemalloc.start()
    for _, _, block in tn.blocks(texts, decontam.BLOCK_BYTES):
        assert not list(decontam._matches(block, index, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20

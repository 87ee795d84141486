"""The additive quality model: measures by hand, tables against brute force, held-out accuracy, and edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from threadtide.llm import additive, textnum

SCHEMA = "doc_id long, text string, quality int, x string, score double"  # clashing extras


def measured(texts):
    parts = [additive.measures(b) for _, _, b in textnum.blocks(pa.array(texts, pa.string()))]
    return [dict(zip(additive.FEATURES, row)) for row in np.concatenate(parts)]


def test_measures():
    none, empty, caps, runs, lines = measured([None, "", "ÀB é! 12 ABC", "a a a a b", "one two\none two\n\nx://y.z three four five, six"])
    assert set(none.values()) == set(empty.values()) - {np.log1p(0)} | {0.0}
    assert caps["capital_words"] == 2 / 4 and caps["upper"] == 5 / 6 and caps["exclamations"] == 1 / 4
    assert caps["digits"] == 2 / 9 and caps["digit_words"] == 1 / 4 and caps["word_length"] == 9 / 4
    assert runs["top_word"] == 4 / 5 and runs["longest_run"] == 4 / 5 and runs["same_as_last"] == 3 / 5
    assert runs["distinct_words"] == 2 / 5 and runs["repeated_windows"] == 0
    assert lines["lines"] == np.log1p(3) and lines["repeated_lines"] == 2 / 3 and lines["links"] == 1 / 9


def test_rows_do_not_touch_each_other():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aB é1!.\n#") for _ in range(rnd.choice([0, 3, 30, 300]))) for _ in range(80)]
    together = measured(texts)
    for text, row in zip(texts, together):
        assert measured([text])[0] == row


def test_line_tree_takes_the_best_cuts():
    rng = np.random.default_rng(0)
    for _ in range(30):
        g, h = rng.normal(size=7) * 20, rng.random(7) * 30 + 6
        step = additive.line_tree(g, h, h)
        parts = {k: g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) for k in range(1, 7)}
        first = max(parts, key=parts.get)
        if parts[first] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            assert step[first - 1] != step[first]
        assert len(set(step)) <= additive.LEAVES


def test_square_tree_takes_the_best_quadrants():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, h = rng.normal(size=(4, 5)) * 20, rng.random((4, 5)) * 30 + 6
        gain, step = additive.square_tree(g, h, h)
        best = 0
        for i in range(1, 4):
            for j in range(1, 5):
                parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
                best = max(best, sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in parts) - g.sum() ** 2 / (h.sum() + 1))
        assert gain == pytest.approx(best)
        assert len(set(step.ravel().tolist())) <= 4


def test_pairs_learn_what_single_numbers_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    edges = [np.linspace(0.1, 0.9, 9)] * 3
    w = np.ones(4000)
    with_pairs, without = (additive.fit(x, y, w, edges, n_pairs=k) for k in (2, 0))
    assert ((with_pairs.score(x) > 0.5) == y).mean() > 0.99 > 0.7 > ((without.score(x) > 0.5) == y).mean()
    assert (0, 1) in with_pairs.pairs
    # scoring is the sum of the tables' bins
    bins = with_pairs.bins(x[:5])
    total = [with_pairs.base + sum(t[b[i]] for i, t in enumerate(with_pairs.main)) + sum(t[b[i], b[j]] for (i, j), t in with_pairs.pairs.items()) for b in bins]
    assert np.allclose(with_pairs.score(x[:5]), 1 / (1 + np.exp(-np.array(total))))


def corpus():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        good = i % 4 > 0
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(30, 120)))
        if not good:
            text = rnd.choice([" ".join([rnd.choice(words)] * 60), text.upper().replace(" ", "!! "), text.replace(" ", "*** ")])
        rows.append((i, text, 5, "x", 0.1))
        labels.append((i, int(good)))
    rows += [(1000, None, 1, "x", None), (1001, "", 1, "x", None), (None, "no id", 1, "x", None), (3, "again", 1, "x", None)]
    rows += [(1002, "word " * 200_000, 1, "x", None), (1003, "漢" * 100_000, 1, "x", None)] + rows[:5] * 2
    labels += [(None, 1), (7, None), (8, 1), (8, 0), (9999, 0)]
    return rows, labels


def test_quality(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")
    got = additive.quality(docs, known).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= additive.CUT) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    late = [r for r in got if r["held_out"] and r["doc_id"] < 900 and r["doc_id"] != 3]
    assert sum(r["predicted"] == (r["doc_id"] % 4 > 0) for r in late) >= 0.97 * len(late) > 100
    again = additive.quality(docs.repartition(7), known).collect()
    assert sorted((r["doc_id"] or -1, r["score"]) for r in got) == sorted((r["doc_id"] or -1, r["score"]) for r in again)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = corpus()
    turned = [(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    docs = spark.createDataFrame(rows[:400], SCHEMA)
    a, b = (additive.quality(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect() for x in (labels, turned))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_few_labels(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows[:50], SCHEMA)
    none = additive.quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.5}
    ones = additive.quality(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")).collect()
    assert len({r["score"] for r in ones}) == 1 and 0.9 < ones[0]["score"] < 1
    assert additive.quality(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_the_sample_is_bounded_and_weighted(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    model = additive.trained(additive.described(docs), known, per_class=60)
    assert model.main and 0.5 < 1 / (1 + np.exp(-model.base)) < 0.85  # three quarters of the labels, not half

"""Spelling variants against brute force, with cells small enough that frequent keys are split."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threadtide.llm import spelling

SCHEMA = "doc_id long, text string, n long, w string, word string"  # clashing extras
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def corpus():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abàÿß") for _ in range(rnd.randint(4, 8))) for _ in range(60)]
    words += [w[: i % len(w)] + rnd.choice("abé") + w[i % len(w) + i % 2 :] for i, w in enumerate(words * 5)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "A×÷Ab", "abcdefgh", "ABCDEFGh", "bcdefgh", "abcdefg", "acdefgh"]
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "1", "漢", ","]) for _ in range(rnd.randint(0, 80))), 1, "x", "y") for i in range(150)]
    long = "".join(rnd.choice("abc") for _ in range(3000))
    rows += [(i, f"{long} {long[:-1]} {long}b {long[:9] + 'z' + long[9:]}", None, None, None) for i in range(500, 504)]
    rows += [(None, "aaaaa aaaab", 1, "x", "y"), (None, None, 1, "x", "y"), (7, "", 1, "x", "y")]
    return rows + [(200, "twice twicE twisted", 1, "x", "y")] * 4


def found(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = found(rows)
    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in others.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return Counter(out)


@pytest.mark.parametrize("cell", [4096, 3])
def test_variants(spark, cell):
    rows = corpus()
    got = spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(4), cell=cell)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert any(w[1] and w[2] != w[1] for w in want)  # some chain has two steps


def test_a_key_of_a_third_of_all_words(spark):
    # all words share the one rare bigram, which is a pivot of each of them
    words = [f"qz{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"]
    got = spelling.variants(spark.createDataFrame([(i, " ".join(words)) for i in range(3)], "doc_id long, text string"), cell=16)
    assert Counter(map(tuple, got.collect())) == brute([(i, " ".join(words)) for i in range(3)])


def test_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "1 2 ab", 1, "x", "y")], SCHEMA)).count() == 0


def test_checksums_of_many_runs():
    rnd = random.Random(1)
    runs = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 5, 40, 300]))) for _ in range(200)]
    ends = np.cumsum([len(r) for r in runs])
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(200)], np.uint32)
    got = spelling.crc32s(np.frombuffer(b"".join(runs), np.uint8), ends - [len(r) for r in runs], ends, before)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + r) for i, r in enumerate(runs)]


def test_pivots_are_disjoint_and_in_the_prefix():
    rng = np.random.default_rng(2)
    rank = rng.integers(0, 9, (500, 12))
    rank[::3, 8:] = 1 << 17
    cost = np.where(rank < 9, rank * 10 + 1, 0)
    inside, first, second = spelling.pivots(rank, cost)
    every = np.arange(500)
    assert (second - first >= 2).all() and inside[every, first].all() and inside[every, second].all()
    for i in range(500):
        pairs = [cost[i, a] + cost[i, b] for a in range(12) for b in range(a + 2, 12) if inside[i, a] and inside[i, b]]
        assert cost[i, first[i]] + cost[i, second[i]] == min(pairs)

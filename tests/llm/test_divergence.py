"""Source divergence against brute force, with digests short enough to collide."""

import random
import re
from collections import Counter, defaultdict

import pytest

from threadtide.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, digest string, n long, term string"  # clashing extras
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def corpus():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcXYé漢") for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    rows = []
    for i in range(300):
        lang, source = rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["a", "b", "É", None])
        text = "".join(rnd.choice(words[: 20 + 40 * (i % 3)]) + rnd.choice([" ", "1", "-", "\n"]) for _ in range(rnd.randint(0, 40)))
        rows.append((i, text, lang, source, "x", 1, "y"))
    rows += [(None, None, "en", "only nulls", "x", 1, None), (1, "", "fr", "a", None, None, None), (1, "12 !", "fr", "b", None, None, None)]
    rows += [(5, "long " * 5000 + "Long" * 5000, "en", "a", "x", 1, "y")] + rows[:2] * 3
    return rows


def brute(rows, least_docs, top):
    n, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERMS.findall(text or "")]
        n.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    kept = defaultdict(list)
    for (lang, t), d in docs.items():
        if d >= least_docs:
            kept[lang].append(t)
    out = []
    share = lambda c, total, v: 1 + 10**9 * (c + 5) // (total + 5 * v)
    for lang, source in groups:
        terms, others = kept[lang], [s for x, s in groups if x == lang and s != source]
        p = {}
        for s in [source, *others]:
            total = sum(n[lang, s, t] for t in terms)
            p[s] = [share(n[lang, s, t], total, len(terms)) for t in terms]
        pairs = [(-sum(abs(x - y) for x, y in zip(p[source], p[s])), s) for s in others]
        out += [(lang, source, "pair", s, -v, i + 1) for i, (v, s) in enumerate(sorted(pairs))]
        every = [sum(n[x, s, t] for x, s in groups if x == lang) for t in terms]
        best = [(share(every[i], sum(every), len(terms)) - p[source][i], t) for i, t in enumerate(terms) if n[lang, source, t]]
        out += [(lang, source, "term", t, -v, i + 1) for i, (v, t) in enumerate(sorted(x for x in best if x[0] < 0)[:top])]
    return Counter(out)


@pytest.mark.parametrize("bits, least_docs, top", [(64, 30, 50), (64, 8, 3), (6, 8, 5), (1, 8, 50)])
def test_audit(spark, bits, least_docs, top):
    rows = corpus()
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), least_docs, top, bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(rows, least_docs, top)


def test_nothing_kept_and_nothing_at_all(spark):
    rows = [(i, "one two", "en", s, "x", 1, "y") for i, s in enumerate("abc")]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute(rows, 30, 50)
    assert len(got) == 6 and {r["value"] for r in got} == {0}
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_stay_exact_when_counts_are_large():
    import numpy as np

    count, total = np.array([8 * 10**15, 7, 3]), np.array([9 * 10**15, 9 * 10**15, 3])
    assert divergence.share(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]

"""The training-data operators against brute force on a small fixture with every edge case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadtide.llm import components, decontam, langid, lines, mixing, quality, quotes, sharding, simhash, substring, tokens
from threadtide.session import fresh_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, row string, size long, fp long"  # clashing extras


def corpus():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, copied = prose(50), prose(120)
    texts = [prose(rnd.randint(1, 150)) for _ in range(60)]
    texts += [prose(20) + "\n" + passage + " " + prose(9) for _ in range(12)]
    texts += [copied] * 25 + [copied.replace(" ", "  ", 3), copied + " more", copied.upper()]
    texts += [f"Shared Line\n {prose(12)}\n\tSHARED line \n\n" for _ in range(11)]
    texts += [None, None, "", " \n\t\n", "a", "a " * 200, "ßİ \U0001f600", prose(30_000), "!!! 123", "x\x00y z"]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "b"][min(i % 7, 2)], "r", 1, 2) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, "no id " + passage, "en", "c", "r", 1, 2)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORDS.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_repetition_rules(docs, rows, empty):
    def want(text):
        w, t = words(text), text or ""
        full = [x for x in t.split("\n") if words(x)]
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(hit), failed)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.repetition_rules(docs).collect()
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == Counter((r[0], *want(r[1])) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert sum(r["kept"] for r in got) > 40
    assert quality.repetition_rules(empty).count() == 0


def test_shards(docs, rows, empty):
    got = sharding.balanced_shards(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert sharding.balanced_shards(empty).count() == 0


def test_shards_keep_groups_that_fit(spark):
    rows = [(i, f"t{i % 10}" if i < 40 else f"own {i}") for i in range(400)] + [(1000 + i, "big") for i in range(120)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of, text = {r["doc_id"]: r["shard"] for r in got}, dict(rows)
    groups = {}
    for i, s in of.items():
        groups.setdefault(text[i], set()).add(s)
    assert all(len(s) == 1 for t, s in groups.items() if t.startswith("t"))
    assert len(groups["big"]) <= 4  # 120 copies, 65 rows a shard


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(tokens.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert tokens.feistel(np.arange(1000), 1000, 1).tolist() != tokens.feistel(np.arange(1000), 1000, 2).tolist()


def test_token_shards_round_trip(spark, docs, rows, empty):
    ranks = {bytes([i]): i for i in range(256)}
    v = tokens.Vocabulary(ranks)
    path = fresh_path(spark, "shards")
    index = tokens.write_training_order(docs, v, path, length=64, shard_rows=100).collect()
    ids = {(r["shard"], r["nth"]): r["ids"] for r in tokens.read_shards(spark, path, 64, v.kind).collect()}
    assert sorted(r["slot"] for r in index) == list(range(len(index))) and len(ids) == len(index)
    got = []
    for r in index:
        assert r["shard"] == r["slot"] // 100 and r["offset"] == r["slot"] % 100 * 129
        body = ids[r["shard"], r["slot"] % 100]
        got += [(p["doc_id"], p["from"], tuple(body[p["at"] : p["at"] + p["n"]])) for p in r["docs"]]
    stream = Counter()
    for d, _, part in got:
        stream[d] += len(part)
    want = Counter()
    for r in rows:
        want[r[0]] += len((r[1] or "").encode()) + 1
    assert stream == want
    for r in rows:
        if r[0] and sum(x[0] == r[0] for x in rows) == 1:
            own = [i for _, _, part in sorted(g for g in got if g[0] == r[0]) for i in part]
            assert bytes(own[:-1]) == (r[1] or "").encode() and own[-1] == v.end
    assert tokens.write_training_order(empty, v, fresh_path(spark, "shards")).count() == 0


def test_language_id(spark, docs, rows, empty):
    rnd = random.Random(1)
    say = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(3)) for _ in range(30))
    known = [(i, say(["the", "ing", "wh"]) if i % 2 else say(["sch", "ung", "ver"]), "en" if i % 2 else "de") for i in range(300)]
    known += [(300, None, "en"), (301, "?! 12", "de"), (302, "the", None), (None, "the ing", "en")]
    table = spark.createDataFrame(known, "doc_id long, text string, lang string")
    model = langid.fit(table, 60)
    got = {r["row"]: r for r in langid.identify(table, model).collect()}
    for i, text, lang in known[:300]:
        assert got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [got[i]["lang_pred"] for i in (300, 301)] == ["und", "und"] and got[301]["score"] == 0
    assert langid.identify(docs, langid.fit(docs)).count() == len(rows)
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty, nothing).count() == 0


def test_temperature_of_sure_mistakes():
    scores = np.array([[4.0, 0.0]] * 100)
    labels = np.array([0] * 75 + [1] * 25)
    assert 1 / (1 + np.exp(-4 / langid.temperature(scores, labels))) == pytest.approx(0.75, abs=1e-3)


def test_quotes(spark):
    hello = "Shall we meet\n\nat noon?"
    mails = [
        (1, 0, "a", hello),
        (1, 1, "b", "On Monday a wrote:\n> Shall  we MEET\n>\n> at noon?\nYes."),
        (1, 2, "a", "Fine"),
        (1, 3, "c", "> > at noon?\n> Yes.\nLate for me"),
        (1, 4, "b", "> Shall we meet\nwhere?"),
        (2, 0, "d", "> Late for me\nOther table"),
        (3, 0, "e", None), (3, 1, "e", ""), (None, 0, "f", "alone"), (3, 1, "e", ""),
    ]
    got = quotes.reply_ordered(spark.createDataFrame(mails, "conv_id long, turn long, role string, text string")).collect()
    by = {(r["conv_id"], r["turn"]): r for r in got}
    answers = {k: (r["answers_conv"], r["answers_turn"]) for k, r in by.items() if k[0] in (1, 2)}
    assert answers == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 1), (1, 4): (1, 0), (2, 0): (1, 3)}
    assert by[1, 1]["content"] == "Yes." and by[1, 3]["content"] == "Late for me"
    thread = sorted((r["position"], r["conv_id"], r["turn"]) for r in got if r["thread"] == by[1, 0]["thread"])
    assert thread == [(0, 1, 0), (1, 1, 1), (2, 1, 4), (3, 1, 2), (4, 1, 3), (5, 2, 0)]
    assert len(got) == len(mails)


def fingerprint(text, k=4):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.mark.parametrize("light", [512, 2])
def test_simhash(docs, rows, empty, light):
    fps = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    want = Counter((r[0], f"{f:016x}", ids[g]) for r, f, g in zip(rows, fps, group))
    got = Counter(map(tuple, simhash.near_duplicates(docs, light=light).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_heavy_keys_link_the_same(spark):
    """Fingerprints of one upper half, around several centres: more than a key's light number of entries."""
    rnd, top = random.Random(3), 0x01234567 << 32
    centres = [top | rnd.getrandbits(32) for _ in range(12)]
    near = lambda c: c ^ sum(1 << b for b in rnd.sample(range(32), rnd.randint(0, 4)))
    fps = sorted({near(c) for c in centres for _ in range(60)} | {0xF << 60 | rnd.getrandbits(32) for _ in range(40)})
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    table = spark.createDataFrame(signed, "fp long").repartition(3)
    for light in (4096, 512, 20, 1):
        values = table.select(F.col("fp").alias("node"), F.col("fp").alias("value"))
        placed = {r["node"]: r["value"] for r in components.components(simhash.links(table, light), values).collect()}
        found = {}
        for (x,), g in zip(signed, group):
            found.setdefault(g, set()).add(placed.get(x, x))
        assert all(len(v) == 1 for v in found.values()) and len({v for x in found.values() for v in x}) == len(set(group)), light


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(n, n + 1)]
    values = spark.createDataFrame([(i, 1000 - i) for i in range(n + 2)], "node long, value long")
    got = components.components(spark.createDataFrame(edges, "a long, b long"), values).collect()
    assert {r["value"] for r in got if r["node"] < n} == {1000 - n + 1} and len(got) == n + 2


def test_tiling_catches_pieces_in_any_order(spark, empty):
    item = "one two three four five six seven eight nine ten eleven twelve"
    moved = "x Seven, eight nine ten eleven twelve! y z one two three four five six"
    texts = [(1, "intro " + item), (2, moved), (3, "one two three x four five six"), (4, None), (5, ""), (6, "tiny test"), (2, moved)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "tiny")], "item_id long, text string")
    got = Counter(map(tuple, decontam.contaminated_pairs(docs, bench).collect()))
    assert got == Counter({(1, 7, 12, 12): 1, (2, 7, 12, 12): 2, (6, 10, 1, 1): 1})
    kept = decontam.clean(docs, bench, F.col("doc_id")).collect()
    assert sorted(r["row"] for r in kept) == [3, 4, 5]
    blocks = decontam.index_blocks(bench, 5)
    assert sum(len(b.ids) for b in blocks) == 2
    assert decontam.contaminated_pairs(empty, bench).count() == 0
    assert decontam.contaminated_pairs(docs, bench.limit(0)).count() == 0


def test_tiles_mark_the_longest_first():
    i, j = np.array([0, 1, 2, 1, 2, 3]), np.array([10, 11, 12, 30, 31, 32])
    assert decontam.tiles(i, j, 3) == [(0, 10, 5)]  # the other match keeps one free word of the item


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    n = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    order = sorted((s for s in n if s is not None)) + [None]
    goal, free, theta = {}, set(order), 0.0
    while free:
        theta = (1.5 * sum(n.values()) - sum(goal.values())) / sum([3, 1, 2][order.index(s) % 3] for s in free)
        full = {s for s in free if theta * [3, 1, 2][order.index(s) % 3] >= 2 * n[s]}
        if not full:
            break
        goal |= {s: 2.0 * n[s] for s in full}
        free -= full
    goal |= {s: theta * [3, 1, 2][order.index(s) % 3] for s in free}
    taken, of = Counter(), {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["target"] == pytest.approx(goal[of[r["row"]]])
        taken[of[r["row"]]] += r["copies"] * r["size"]
    assert len(got) == len(rows)
    giant = next(r[3] for r in rows if len(words(r[1])) == 30_000)  # one text is most of this source
    assert all(abs(taken[s] - goal[s]) <= max(20, 0.02 * goal[s]) for s in ("a", "b", "c") if s != giant)
    assert sorted(got, key=str) == sorted(mixing.mix(docs.repartition(3)).collect(), key=str)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("light", [256, 1])
def test_substring_dedup(docs, rows, empty, light):
    every = [words(r[1]) for r in rows]
    wins = Counter(tuple(w[i : i + 35]) for w in every for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, every):
        hit = {j for i in range(len(w) - 34) if wins[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[r[0], len(w), len(hit), " ".join(x for j, x in enumerate(w) if j not in hit)] += 1
    got = substring.drop_repeats(docs, light=light)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "text").collect())) == want
    assert substring.drop_repeats(empty).count() == 0


def test_automaton_counts_like_search():
    rnd = random.Random(4)
    seqs = [[rnd.randint(0, 1) for _ in range(rnd.randint(5, 30))] for _ in range(8)]
    a = substring.Automaton()
    for s in seqs:
        a.add(s, 1)
    a.close()
    wins = Counter(tuple(s[i : i + 5]) for s in seqs for i in range(len(s) - 4))
    for s in seqs:
        assert a.repeats(s, 5) == [i for i in range(len(s) - 4) if wins[tuple(s[i : i + 5])] > 1]


@pytest.mark.parametrize("batches, fanout", [(4, 2), (1, 2), (7, 3)])
def test_line_runs(docs, rows, empty, batches, fanout):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    count = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    want = Counter()
    for r in rows:
        every = (r[1] or "").split("\n")
        kept = [x for x in every if not key(x) or count[key(x)] < 10]
        want[r[0], len(every), len(every) - len(kept), "\n".join(kept)] += 1
    got = lines.drop_common_lines(docs, batches=batches, fanout=fanout)
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect())) == want
    assert lines.drop_common_lines(empty).count() == 0


def test_pipeline_against_the_operators_in_plain_python(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    out = corpus_pipeline.run(spark, sf).select("doc_id", "slot", "seq_from").collect()
    ids = {r["doc_id"] for r in out}
    rows = docs.collect()
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    for r in rows:
        leaks = any(b["text"] in r["text"] for b in bench)
        copy = any(o["doc_id"] < r["doc_id"] and (fps[o["doc_id"]] ^ fps[r["doc_id"]]).bit_count() <= 4 for o in rows)
        assert not (r["doc_id"] in ids and (leaks or copy))
    assert 0.5 * len(rows) < len(ids) < len(rows)
    assert len({(r["slot"], r["seq_from"]) for r in out}) == len(out)


@pytest.mark.parametrize("size, least", [(2, 0.9), (10, 0.9), (200, 0.3)])
def test_shards_exchange_groups(spark, size, least):
    n = 8_000
    rows = [(i, f"text {i // size}") for i in range(n)]
    placed = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set(Counter(r["shard"] for r in placed).values()) == {n // 8}
    at = {}
    for r in placed:
        at.setdefault(r["doc_id"] // size, set()).add(r["shard"])
    assert sum(len(x) == 1 for x in at.values()) >= least * len(at)


def test_near_duplicates_of_the_pipeline(spark):
    import corpus_pipeline

    rnd = random.Random(11)
    prose = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(25):
        base = prose(rnd.randint(60, 300))
        texts.append(base)
        for _ in range(3):
            near = list(base)
            for at in rnd.sample(range(len(near)), rnd.randint(0, len(near) // 60)):
                near[at] = "changed"
            texts.append(near)
    texts = [" ".join(t) for t in texts] + ["short text", "Short  TEXT", "other text", "", None]
    rows = [(i // 2 if i % 9 else None, t, "en", "a", "r", 1, i) for i, t in enumerate(texts)]
    fps = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                group = [group[j] if g == group[i] else g for g in group]
    assert len(set(group)) < 0.7 * len(rows)
    docs = spark.createDataFrame(rows + rows[:9] + rows[-1:] * 3, SCHEMA)  # equal rows are one
    kept = corpus_pipeline.near_duplicates(spark, docs.repartition(4), "").collect()
    assert sorted(group[r["fp"]] for r in kept) == sorted(set(group))  # one row of each group
    least = {}
    for g, r in zip(group, rows):
        least[g] = min(least.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert all(least[group[r["fp"]]] == (r["doc_id"] is None, r["doc_id"] or 0) for r in kept)
    assert sorted(map(repr, kept)) == sorted(map(repr, corpus_pipeline.near_duplicates(spark, docs.repartition(7), "").collect()))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0

"""Matching, threads, sources and streaming on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadtide.operators import labelling, matching, threads
from threadtide.operators.sampling import keep_first
from threadtide.session import cut_lineage
from threadtide.sources import files
from threadtide.sources.schemas import COUNTERS
from threadtide.streaming import jobs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.choice([12, 22, 38, 41, 90, 200]))) for _ in range(24)]

    def damaged(t, share):
        chars = list(t)
        for _ in range(int(len(t) * share)):
            i = rnd.randrange(len(chars))
            chars[i] = rnd.choice(["", rnd.choice(letters), chars[i] + rnd.choice(letters)])
        return "".join(chars)

    left = [(i, damaged(t, s)) for i, (t, s) in enumerate((t, s) for t in base for s in (0, 0.02, 0.05, 0.12, 0.3))]
    return left, list(enumerate(base))


def best(left, right, floor):
    out = {}
    for i, a in left:
        scored = [(-(1 - edits(a, b) / max(len(a), len(b))), j) for j, b in right]
        s, j = min(scored)
        if -s >= floor:
            out[i] = (j, round(-s, 9))
    return out


@pytest.mark.parametrize("search, floor", [(False, matching.NEAR), (True, matching.FLOOR)])
def test_matches_equal_brute_force(spark, texts, search, floor):
    left, right = texts
    a = spark.createDataFrame(left, "id int, t string")
    b = spark.createDataFrame(right, "rid int, r string")
    got = matching.match_texts(a, b, "id", "t", "rid", "r", search=search).collect()
    assert {r["id"]: (r["match_id"], round(r["score"], 9)) for r in got} == best(left, right, floor)


def test_normalisation_and_report(spark):
    a = spark.createDataFrame([(1, "Text: Hello, World 7"), (2, "nothing here at all"), (3, None)], "id int, t string")
    b = spark.createDataFrame([(5, "hello world"), (4, "HELLO world!")], "rid int, r string")
    got = matching.match_texts(a, b, "id", "t", "rid", "r")
    assert [(r["id"], r["match_id"], r["method"]) for r in got.collect()] == [(1, 4, "exact_alphanum")]
    report = {r["method"]: r["n"] for r in matching.match_report(a, got, "id").collect()}
    assert report == {"exact_alphanum": 1, "unmatched": 2}
    with pytest.raises(ValueError):
        matching.assert_complete(a, got, "id")


def reply(user, link, below=()):
    return {"username": user, "content": f"hi @{user}", "likes": 1, "link": link, "replies_content": list(below)}


TREE = [reply("p", "1", [reply("a", "2", [reply("b", "3"), reply("c", "4")]), reply("d", "5")]), reply("p", "6")]
FLAT = [("1", ""), ("2", "1"), ("3", "2"), ("4", "2"), ("5", "1"), ("6", "")]


def write(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))


def test_read_and_flatten(spark, tmp_path):
    write(tmp_path, "alice.json", TREE)
    write(tmp_path, "bob.json", TREE[1])
    write(tmp_path, "carl.json", '[{"username": "x", ')
    write(tmp_path, "dora.json", [{}])
    posts, bad = files.read_threads(spark, str(tmp_path))
    flat = threads.flatten_threads(posts)
    got = [(r["author_id"], r["id"], r["parent_id"]) for r in flat.collect()]
    assert sorted(got) == sorted([("alice", *f) for f in FLAT] + [("bob", "6", "")])
    assert [r["file"] for r in bad.collect()] == ["carl.json"]


def test_comment_ids_follow_the_tree(spark, tmp_path):
    write(tmp_path, "alice.json", TREE)
    posts, _ = files.read_threads(spark, str(tmp_path))
    table = threads.comments_table(threads.numbered_posts(posts.withColumn("o", F.col("link").cast("int")), "o"))
    got = {r["commenter_id"]: (r["comment_id"], r["parent_id"], r["num_tagged_people"]) for r in table.collect()}
    assert got == {"a": (1, None, 1), "b": (2, 1, 1), "c": (3, 1, 1), "d": (4, None, 1)}


def nested(depth):
    """A chain of replies, written by hand: deeper than the encoder goes."""
    text = '{"username": "u", "link": "1"'
    for i in range(2, depth + 1):
        text += f', "replies_content": [{{"username": "u", "link": "{i}"'
    return text + "}" + "]}" * (depth - 1)


def test_threads_of_any_depth(spark, tmp_path):
    write(tmp_path, "alice.json", nested(50))
    write(tmp_path, "broken.json", '[{"username": "x", ')
    write(tmp_path, "deep.json", nested(700))
    write(tmp_path, "flat.json", '{"username": "u", "replies_content": "none"}')
    posts, bad = files.read_threads(spark, str(tmp_path))
    unread = ["broken.json", "deep.json", "flat.json"]
    assert sorted(r["file"] for r in bad.collect()) == unread
    got = [(r["id"], r["parent_id"], len(r["path"])) for r in threads.flatten_threads(posts).collect()]
    assert sorted(got) == sorted((str(i), str(i - 1) if i > 1 else "", i - 1) for i in range(1, 51))
    sink = str(tmp_path / "out")
    jobs.ingest_threads(spark, str(tmp_path / "*.json"), sink, str(tmp_path / "state"))
    assert jobs.ingested_total(spark, sink).first()["rows"] == 50
    assert sorted(r["file"] for r in spark.read.parquet(sink + ".bad").collect()) == unread


def test_four_hundred_levels_are_read(spark, tmp_path):
    write(tmp_path, "alice.json", nested(400))
    posts, bad = files.read_threads(spark, str(tmp_path))
    assert bad.count() == 0
    assert [r["direct_replies"] for r in threads.direct_replies(posts).collect()] == [1]


def test_many_levels_unfold_in_passes(spark, tmp_path):
    write(tmp_path, "alice.json", nested(40))
    posts, _ = files.read_threads(spark, str(tmp_path))
    got = {r["id"]: len(r["path"]) for r in threads.flatten_threads(posts).select("id", "path").collect()}
    assert got == {str(i): i - 1 for i in range(1, 41)}


def test_replies_of_every_shape(spark):
    replies = json.dumps([
        {"link": "2", "likes": 3, "views": None, "replies_content": [None, {"link": "3", "username": "w"}]},
        None, {"replies_content": []}, {"link": "4", "content": "é \u0001", "replies_content": None}])
    posts = spark.createDataFrame([("1", "u", "c", replies), ("9", None, None, None), ("8", "v", "", "[]")],
                                  "link string, username string, content string, replies_content string")
    posts = posts.selectExpr("*", *[f"cast(null as bigint) {c}" for c in COUNTERS])
    got = sorted((r["id"], r["username"], r["content"], r["parent_id"], r["parent_username"], r["likes"], r["views"], tuple(r["path"]))
                 for r in threads.flatten_threads(posts).collect())
    assert got == [
        ("", "", "", "1", "u", 0, 0, (2,)), ("1", "u", "c", "", "", 0, 0, ()), ("2", "", "", "1", "u", 3, 0, (0,)),
        ("3", "w", "", "2", "", 0, 0, (0, 1)), ("4", "", "é \u0001", "1", "u", 0, 0, (3,)), ("8", "v", "", "", "", 0, 0, ()),
        ("9", "", "", "", "", 0, 0, ())]


def test_cycles_are_told(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 1, 1)], "t int, n int, p int")
    with pytest.raises(ValueError):
        threads.tree_depths(rows, "t", "n", "p")


def test_typed_replies(spark):
    schema = "link string, username string, content string, likes long, retweet long, share long, views long, replies long"
    posts = spark.createDataFrame(
        [("1", "p", None, 1, 1, 1, None, 1, [("2", "a", "x", 1, 1, 1, 1, 1)], "z")],
        f"{schema}, replies_content array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>, author_id string")
    got = sorted((r["id"], r["parent_id"], r["content"], r["views"]) for r in threads.flatten_threads(posts).collect())
    assert got == [("1", "", "", 0), ("2", "1", "x", 1)]


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(threads, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    n = 10_000
    chain = spark.range(n).selectExpr("7 t", "id n", "CASE WHEN id % 5000 > 0 THEN id - 1 END p")
    got = threads.tree_depths(chain, "t", "n", "p")
    assert got.where("depth <> n % 5000").isEmpty() and got.count() == n
    assert len(written) <= 15 + 1


def test_orphans_have_no_depth(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 99), (1, 3, 2), (2, 1, 0)], "t int, n int, p int")
    assert sorted(map(tuple, threads.tree_depths(rows, "t", "n", "p").collect())) == [(1, 0, 0), (1, 1, 1)]
    assert threads.tree_depths(rows.limit(0), "t", "n", "p").count() == 0


def test_post_numbers_above_the_precision_of_doubles(spark):
    rows = spark.createDataFrame([("a", 2**60 + i) for i in (3, 1, 2, 0)] + [("b", 5)], "author_id string, o long")
    got = {(r["author_id"], r["o"]): r["post_id"] for r in threads.numbered_posts(rows, "o").collect()}
    assert got == {("a", 2**60 + i): i + 1 for i in range(4)} | {("b", 5): 1}


def test_deep_trees(spark):
    chain = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(6)], "t int, n int, p int")
    got = {r["n"]: r["depth"] for r in threads.tree_depths(chain, "t", "n", "p").collect()}
    assert got == {i: i for i in range(6)}


def test_two_file_drops_equal_one_batch(spark, tmp_path):
    source, sink, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    write(source, "alice.json", TREE)
    jobs.ingest_threads(spark, str(source), str(sink), str(state))
    write(source, "bob.json", TREE)
    for _ in range(2):
        jobs.ingest_threads(spark, str(source), str(sink), str(state))
    got = sorted((r["author_id"], r["id"]) for r in spark.read.parquet(str(sink)).collect())
    assert got == sorted((a, i) for a in ("alice", "bob") for i, _ in FLAT)


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith lines'), (2, "plain")]
    files.write_csv(spark.createDataFrame(rows, "id int, t string"), str(tmp_path / "c"), ["id", "t"])
    back = files.read_csv(spark, str(tmp_path / "c"), "id int, t string")
    assert sorted((r["id"], r["t"]) for r in back.collect()) == rows


def test_scorer_failures_become_null(spark):
    import pandas as pd

    def load():
        def score(texts):
            if texts.str.contains("boom").any():
                raise RuntimeError("model failed")
            return pd.DataFrame({"n": texts.str.len()})

        return score

    df = spark.createDataFrame([(1, "abc"), (2, None)], "k int, t string").coalesce(1)
    got = {r["k"]: r["n"] for r in labelling.score_batches(df, "t", load, "n long").collect()}
    assert got == {1: 3, 2: None}
    mixed = spark.createDataFrame([(1, "abc"), (2, "boom"), (3, "de"), (4, None)], "k int, t string").coalesce(1)
    assert {r["k"]: r["n"] for r in labelling.score_batches(mixed, "t", load, "n long").collect()} == {1: 3, 2: None, 3: 2, 4: None}
    broken = spark.createDataFrame([(1, "boom")], "k int, t string")
    assert labelling.score_batches(broken, "t", load, "n long").first()["n"] is None


def test_keep_first(spark):
    df = spark.createDataFrame([(2, "a", "x"), (1, "a", "y"), (3, "b", "z")], "id int, k string, v string")
    assert sorted((r["k"], r["id"], r["v"]) for r in keep_first(df, ["k"], "id").collect()) == [("a", 1, "y"), ("b", 3, "z")]


def test_registered_near_match_searches_below_the_near_copies(spark, tmp_path):
    from threadtide.plans import catalog

    text = "the quick brown fox jumps over the lazy dog while seven wizards box"
    worse = text[:20] + "zzzzzzzzzz" + text[30:]  # about a fifth of the letters
    docs = [(i, t, "en", "web", len(t)) for i, t in enumerate((text, worse, "nothing alike whatsoever in here"), 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (row,) = catalog.ENTRIES["J11_near_match"].build(spark, str(tmp_path)).collect()
    assert (row["doc_id"], row["match_id"]) == (1, 2) and 0.65 <= row["score"] < 0.95

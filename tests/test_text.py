"""Features and cleaning steps on literal rows."""

import pytest
from pyspark.sql import functions as F

from threadtide.functions import clean as cl
from threadtide.functions import text as tx
from threadtide.operators import cleaning, quality


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize("text, build, want", [
    ("OMG this is CRAZY 😂😂", tx.emoji_count, 2),
    ("OMG this is CRAZY 😂😂", tx.caps_words, 2),
    ("ÉOMG and A1B ABC", tx.caps_words, 1),
    ("naïve 😂", tx.non_ascii_chars, 2),
    ("ok :) :) XD ^_^", tx.emoticon_count, 5),
    ("¯\\_(ツ)_/¯", tx.emoticon_count, 2),
    ("a ._. b", tx.emoticon_count, 1),
    ("see https://t.co/x/photo/1", tx.has_media_link, True),
    ("see HTTPS://t.co", tx.has_link, False),
    ("hey @Grok!", tx.mentions_account, True),
    ("hey @grokking", tx.mentions_account, False),
    ("that is sus", tx.uses_slang, True),
    ("with w/o nothing", tx.uses_slang, True),  # the piece "w" is a term
    ("suspicious", tx.uses_slang, False),
    ("One two. Three four five! ", tx.sentence_length, 3.0),  # a leading blank counts as a piece
    ("However, thus.", tx.formal_words, 2),
])
def test_features(spark, text, build, want):
    assert one(spark, text, build) == want


def test_mentions_without_authors(spark):
    row = spark.createDataFrame([("@A @b @B @c", "a", "B")], "t string, p string, q string")
    got = row.select(tx.tagged_people(F.col("t"), F.col("p"), F.col("q")).alias("n")).first()["n"]
    assert got == 1


@pytest.mark.parametrize("text, build, want", [
    ("#BreakingNews now", cl.split_hashtags, "breaking news now"),
    ("#COVID19", cl.split_hashtags, "covid 19"),
    ("a # b #x1", cl.split_hashtags, "a # b x 1"),
    ("7k and 1,000 or 1st", cl.mark_numbers, "number and number or number"),
    ("soooooo goood", cl.squeeze_repeats, "soo good"),
    ("see https://a.b/photo/1 https://a.b", cl.mark_links, "see media link"),
    ("RT @x: hi", cl.drop_retweet, "hi"),
    ("@a @b hi @c", cl.drop_mentions, "hi tag"),
    ("está Straße œuvre", cl.transliterate, "esta Strasse oeuvre"),
    ("I don't, they're", cl.expand_contractions, "I do not, they are"),
    ("in 2024 or 7", cl.typed_numbers, "in year or number"),
    ("5/6 then 7", cl.typed_numbers, "date/date then date"),
    ("at 9:30 x", cl.typed_numbers, "at time:time x"),
    ("to CA and in UK", cl.expand_places(), "to california and indiana united kingdom"),
    ("in UK", cl.expand_places(case_sensitive=True), "in united kingdom"),
    ("a • b", cl.drop_lone_symbols, "a b"),
    ("  A  b ", cl.tidy, "a b"),
    (None, cl.not_null, ""),
])
def test_steps(spark, text, build, want):
    assert one(spark, text, build) == want


def test_prefix_of_a_name_is_dropped_too(spark):
    row = spark.createDataFrame([("@bobby hi @BOB x", "bob")], "t string, a string")
    assert row.select(cl.drop_mention_of(F.col("a"))(F.col("t")).alias("o")).first()["o"] == "by hi x"


WORDS = ["follow", "abc", "def", "the", "number", "in"]


def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "term string")


def test_leet_repair(spark):
    tokens = spark.createDataFrame([(t,) for t in ("f0ll0w", "abc123def", "123", "zz9q", "1n")], "token string")
    got = {r["token"]: r["repaired"] for r in cleaning.repair_digit_words(tokens, words(spark)).collect()}
    assert got == {"f0ll0w": "follow", "abc123def": "abc number def", "123": "number", "1n": "in"}


def test_whole_variants(spark):
    rows = spark.createDataFrame(
        [(1, "me", "RT @x: @me It's sooo gr8!!! never f0ll0w 5 abc12 @you https://t.co/1 #BigNews"), (2, "me", None)],
        "k int, a string, t string")
    topics = {r["k"]: r["o"] for r in cleaning.clean_for_topics(rows, "k", "t", "a", words(spark), "o").collect()}
    assert topics == {1: "it soo great not follow abc number tag link big news", 2: ""}
    lexical = {r["k"]: r["o"] for r in cleaning.clean_for_lexicon(rows, "k", "t", "a", words(spark), "o").collect()}
    # "gr8!!" keeps its marks, so it is no slang term, and cannot be read as words
    assert lexical == {1: "it is soo never follow number abc number tag link big news", 2: ""}


def test_validator_on_hyphens(spark):
    rows = spark.createDataFrame([
        (1, "tolerance--gt very well"), (2, "inevitable-tag"), (3, "clean text"), (4, None), (5, "x-1"), (6, "Up"),
    ], "id int, c string")
    got = {r["id"]: r["reason"] for r in quality.cleaning_errors(rows, "id", ["c"]).collect()}
    mark = "Contains punctuation/special chars/apostrophes"
    assert got == {1: mark, 2: mark, 6: "Contains uppercase"}


# ------------------------------------------------------------------------------- emojis at size

EMOJI_TEXTS = [
    "plain", "", None, "naïve Größe Ωδη Привет 日本語 カナ — “x” … #1 *2", "😂😂 a 👩‍👩‍👧 b 👍🏽", "🇩🇪🇫🇷🇦", "1️⃣ #⃣ *️⃣ 1️ 2",
    "🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f and 🏴", "©®‼™ℹ↔⌚⏩Ⓜ▪☀✂⤴⬅⭐〰〽㊗㊙ 🀄🃏🅰🈁🉐🌀🟠🟰🪀", "❤️‍🔥 _x_ ❤",
]


def test_fast_emoji_pattern_finds_what_the_plain_one_finds(spark):
    df = spark.createDataFrame([(t,) for t in EMOJI_TEXTS], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    rows = df.select(found(tx.EMOJI_SEQUENCE).alias("plain"), found(tx.EMOJI_FAST).alias("fast"),
                     tx.emoji_count(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r["fast"] == r["plain"] and r["n"] == (None if r["plain"] is None else len(r["plain"]))


def test_every_emoji_sign_is_in_the_hint(spark):
    signs = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    lost = signs.where(F.col("c").rlike(f"[{tx.EMOJI_SIGNS}]") & ~F.col("c").rlike(tx.EMOJI_HINT))
    assert signs.where(F.col("c").rlike(f"[{tx.EMOJI_SIGNS}]")).count() > 1000 and lost.count() == 0


def test_counting_emojis_costs_little_on_letters(spark):
    """Every character was tried on each of more than a hundred ranges: some 2 s a MB."""
    import time

    letters = F.concat(F.repeat(F.lit("plain letters und Größe "), 60_000), F.col("id").cast("string"))
    count = lambda: spark.range(4).select(letters.alias("t")).agg(F.sum(tx.emoji_count(F.col("t")))).collect()
    count()
    start = time.time()
    count()
    assert time.time() - start < 2


def test_reasons_are_told_once(spark):
    """A filter on the reasons made the plan tell them twice."""
    df = spark.createDataFrame([(1, "Bad  one"), (2, "good"), (3, None), (4, "  x"), (5, "a\u00a0"), (6, "7 ok")], "id int, t string")
    out = quality.cleaning_errors(df, "id", ["t"])
    assert {r["id"]: r["reason"] for r in out.collect()} == {
        1: "Contains uppercase; Contains double spaces", 4: "Leading/Trailing whitespace; Contains double spaces",
        5: "Contains punctuation/special chars/apostrophes; Leading/Trailing whitespace"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[^a-z \p{L}") == 1


@pytest.mark.parametrize("keep", [True, False])
def test_slang_keys_stay_in_line(spark, keep):
    strip = cl.SLANG_KEY_TOPICS.replace("-", "")
    assert one(spark, "a -- u ~~ b", cl.translate_slang(strip, keep)).split() == (
        ["a", "--", "you", "~~", "b"] if keep else ["a", "you", "b"])

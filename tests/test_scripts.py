"""Emojis as they are seen and letters of other scripts, against rows written out by hand."""

import pytest
from pyspark.sql import functions as F

from threadtide.functions import clean, lookups, text

EMOJIS = [
    ("no emoji, only ✓ ★ and ™", 1), ("😂😂", 2), ("a👍🏽b", 1), ("👨‍👩‍👧‍👦 family", 1), ("🇩🇪🇫🇷", 2), ("1️⃣ and #️⃣ but 1 #", 2),
    ("❤️‍🔥❤", 2), ("🏴󠁧󠁢󠁥󠁮󠁧󠁿", 1), ("🧑🏻‍🚀🚀", 2), ("⭐⌚▶️", 3), ("", 0), ("🇩", 0), ("👩🏽‍❤️‍💋‍👨🏿", 1),
]


def test_emoji_counts(spark):
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(EMOJIS)], "id int, t string, n int")
    got = df.select("t", "n", text.emoji_count(F.col("t")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["n"]) for r in got]


def test_emoji_names(spark):
    rows = ["so 😂!", "👍🏽", "🚀🎉", "🇩🇪 a_b", "none", "❤️ x", "👩‍🚀", None]
    names = spark.createDataFrame(lookups.emoji_names() + [("👨‍👩‍👧", "family")], "emoji string, name string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, "👨‍👩‍👧"])], "id int, t string")
    got = {r["id"]: r["o"] for r in text.with_emoji_names(df, "id", "t", names, "o").collect()}
    want = ["so  emo-face with tears of joy- !", " emo-thumbs up medium skin tone- ", " emo-rocket-  emo-party popper- ",
            " emo-flag DE-  a b", "none", " emo-red heart-  x", " emo-woman rocket- ", None, " emo-family- "]
    assert [got[i] for i in range(9)] == want


SPELLED = [
    ("Привет, мир", "Privet, mir"), ("Щука жуёт ель", "Shchuka zhuiot el'"), ("Αθήνα", "Athena"), ("ψυχή", "psukhe"),
    ("שלום", "shlvm"), ("سلام", "slam"), ("नमस्ते", "nmste"), ("さくら カタカナ", "sakura katakana"), ("しつふ", "shitsufu"),
    ("é naïve ß", "e naive ss"), ("plain", "plain"), ("ＡＢ１２", "AB12"), ("१२३", "123"), ("", ""), ("x😂", "x😂"),
]


def test_scripts(spark):
    df = spark.createDataFrame([(t, w) for t, w in SPELLED], "t string, w string")
    got = df.select("t", "w", clean.transliterate(F.col("t")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["w"]) for r in got]


def test_readings_of_the_caller(spark):
    df = spark.createDataFrame([("東京 tower",), (None,)], "t string")
    got = [r[0] for r in df.select(clean.spelled(F.col("t"), {"東": "dong", "京": "jing "})).collect()]
    assert got == ["dongjing  tower", None]


@pytest.mark.parametrize("text_", ["Привет", "Ελλάδα", "नमस्ते", "さくら", "سلام"])
def test_no_script_is_lost_in_cleaning(spark, text_):
    words = spark.createDataFrame([("x",)], "term string")
    from threadtide.operators import cleaning

    out = cleaning.clean_for_topics(spark.createDataFrame([(1, text_)], "id int, t string"), "id", "t", None, words)
    assert out.first()["cleaned_topics"]

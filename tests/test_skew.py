"""Joins on keys that a third of all rows hold, and how evenly they are dealt."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadtide.operators import joins, ranks, skew


def tables(spark, n=12_000):
    """A third of the rows hold one key, the rest a thousand; some keys are NULL or unknown."""
    many = spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 1000).cast("string"))).alias("key"))
    one = spark.range(900).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("value")).unionByName(
        spark.createDataFrame([("hot", -1), (None, -2)], "key string, value long"))
    return many, one


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(spark, how):
    many, one = tables(spark)
    got = skew.join_hot(many, one, ["key"], how, parts=16)
    want = many.join(one, ["key"], how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert skew.join_hot(many.limit(0), one, ["key"], how).count() == 0


def test_rows_that_repeat_and_several_rows_a_key(spark):
    many = spark.createDataFrame([("a", 1)] * 50 + [("b", i) for i in range(50)], "k string, x int")
    one = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r")], "k string, y string")
    got = skew.join_hot(many, one, ["k"], parts=4).collect()
    assert len(got) == 150 and sum(r["y"] == "r" for r in got) == 50


def test_other_joins_are_refused(spark):
    many, one = tables(spark, 30)
    with pytest.raises(ValueError):
        skew.join_hot(many, one, ["key"], "full")


def dealt(df, keys, n):
    """Rows per partition when rows go by a hash of the keys."""
    return [r["n"] for r in df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(n)).alias("p")).agg(F.count("*").alias("n")).collect()]


def test_a_hot_key_is_spread(spark):
    many, _ = tables(spark, 60_000)
    hot = skew.hot_keys(many, ["key"], parts=16)
    found = hot.collect()
    assert [(r["key"], r["_places"]) for r in found] == [("hot", 22)]
    salted = many.join(hot, ["key"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("id", "key"), F.coalesce("_places", F.lit(1))))
    plain, spread = dealt(many, ["key"], 16), dealt(salted, ["key", "salt"], 16)
    middle = sorted(plain)[8]
    assert max(plain) > 8 * middle and max(spread) < 3 * sorted(spread)[8]


def test_the_table_of_hot_keys_is_bounded(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"))
    for parts in (1, 2, 16, 400):
        assert skew.hot_keys(df, ["k"], parts).count() <= skew.PARTS_OF_A_SHARE * parts


def test_ranks_and_lookups_with_a_hot_value(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = {r["id"]: r["r"] for r in ranks.with_mid_ranks(df, "v", "r").collect()}
    values = sorted(5.0 if i % 3 else float(i) for i in range(3000))
    first, last = values.index(5.0), 3000 - values[::-1].index(5.0)
    assert len(got) == 3000 and {got[i] for i in range(3000) if i % 3} == {(first + 1 + last) / 2}
    links = spark.createDataFrame([("short", "long")], "link string, target string")
    looked = joins.looked_up(df.select("id", F.when(F.col("id") % 3 > 0, "short").alias("url")), "url", links, "link", "target", "out")
    assert Counter(r["out"] for r in looked.collect()) == {"long": 2000, None: 1000}

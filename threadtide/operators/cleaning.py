"""Cleaning of whole tables: the two live variants, the notebook variants, leet repair and its logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtide.functions import clean as cl
from threadtide.functions import lookups as lk
from threadtide.operators.skew import join_hot
from threadtide.session import cut_lineage

# Readings of the digits 0 and 1, tried in this order; 3, 6 and 9 are always e, g and g.
LEET_READINGS = [("o", "i"), ("u", "i"), ("o", "one"), ("u", "one"), ("no", "i"), ("no", "one")]


def readings(token: Column) -> Column:
    """The candidate spellings of a token with digits, lower-cased, in order of preference."""
    base = F.translate(F.lower(token), "369", "egg")
    return F.array(*[
        F.replace(F.replace(base, F.lit("0"), F.lit(zero)), F.lit("1"), F.lit(one)) for zero, one in LEET_READINGS
    ])


def repair_digit_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, repaired) for every distinct token with a digit that can be read as words.

    ``tokens`` has a ``token`` column, ``words`` a ``term`` column of lower-case words. A pure number
    becomes ``number``; else the first reading found among the words wins; else the token is split into
    letter and digit runs if all its letter runs are words. Unreadable tokens have no row. The joins run
    over distinct tokens, not over the text.
    """
    vocabulary = tokens.select("token").distinct()
    terms = words.select(F.col("term").alias("candidate")).distinct()
    spelled = vocabulary.select("token", F.posexplode(readings(F.col("token"))).alias("place", "candidate"))
    by_reading = spelled.join(terms, "candidate", "left_semi").groupBy("token").agg(
        F.min_by("candidate", "place").alias("reading")
    )
    runs = F.regexp_extract_all("token", F.lit("[A-Za-z]+"), F.lit(0))
    letters = vocabulary.select("token", F.explode(F.array_distinct(F.transform(runs, F.lower))).alias("candidate"))
    known = letters.join(terms.withColumn("_k", F.lit(1)), "candidate", "left").groupBy("token").agg(
        (F.count("_k") == F.count("*")).alias("all_known")
    )
    parts = F.regexp_extract_all("token", F.lit(r"[A-Za-z]+|\d+"), F.lit(0))
    spelled_out = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), "number").otherwise(F.lower(p))), " ")
    repaired = (
        F.when(F.col("token").rlike(r"^\d+$"), "number")
        .when(F.col("reading").isNotNull(), F.col("reading"))
        .when(F.col("all_known"), spelled_out)
    )
    return (
        vocabulary.join(by_reading, "token", "left").join(known, "token", "left")
        .select("token", repaired.alias("repaired")).where(F.col("repaired").isNotNull())
    )


def _apply(df: DataFrame, name: str, groups: list[list[cl.Step]]) -> DataFrame:
    for group in groups:
        c = F.col(name)
        for step in group:
            c = step(c)
        df = df.withColumn(name, c)
    return df


def _finish(df: DataFrame, key: str, text: str, groups: list[list[cl.Step]], words: DataFrame,
            last: Callable[[Column], Column], out: str) -> DataFrame:
    """Run the steps once, repair digit words through the word list, then the last token part.

    The tokens are a written stage. Texts with a digit word are joined to their repairs; the others, mostly the most, are not
    shuffled. A token that many texts share is looked up in several places.
    """
    has_digit = lambda w: w.rlike(r"\d")
    tokens = cl.ascii_tokens(cl.split_words(F.col("_t")))
    split = _apply(df.withColumn("_t", F.col(text)), "_t", groups).withColumn("_t", tokens)
    whole = cut_lineage(split.withColumn("_own", F.array_distinct(F.filter("_t", has_digit))))
    held = whole.where(F.size("_own") > 0).select(key, F.explode("_own").alias("token"))
    fixes = join_hot(held, repair_digit_words(held, words), ["token"]).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "repaired"))).alias("_fix")  # one text's own tokens
    )
    read = F.flatten(F.transform("_t", lambda w: F.when(
        has_digit(w), F.split(F.coalesce(F.element_at(F.col("_fix"), w), F.lit("")), " ")
    ).otherwise(F.array(w))))
    mended = whole.where(F.size("_own") > 0).join(fixes, key, "left").withColumn("_t", read).drop("_fix")
    both = mended.unionByName(whole.where(F.size("_own") == 0))
    kept = F.filter("_t", lambda w: w != "")
    return both.withColumn("_t", kept).withColumn(out, cl.tidy(cl.joined(last(F.col("_t"))))).drop("_t", "_own")


def clean_for_topics(df: DataFrame, key: str, text: str, author: str | None, words: DataFrame,
                     out: str = "cleaned_topics") -> DataFrame:
    """C-A: the topic variant of the cleaning, as column ``out``. ``key`` must be unique."""
    groups = cl.steps_topics(F.col(author) if author else None)
    return _finish(df, key, text, groups, words, cl.topic_tokens, out)


def clean_for_lexicon(df: DataFrame, key: str, text: str, author: str | None, words: DataFrame,
                      out: str = "cleaned_lexicon") -> DataFrame:
    """C-B: the lexicon variant of the cleaning."""
    groups = cl.steps_lexicon(F.col(author) if author else None)
    return _finish(df, key, text, groups, words, cl.lexicon_tokens, out)


def resolve_links(df: DataFrame, key: str, text: str, links: DataFrame, out: str) -> DataFrame:
    """C8 with a link map: every link becomes ``media`` or ``link`` by what it resolves to.

    Links are exploded, looked up by an equi-join and regrouped per text (a text's own links only).
    """
    url = F.col("url")
    held = df.where(F.col(text).rlike("https?://")).select(
        key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"https?://[^\s]+"), F.lit(0))).alias("pos", "raw")
    ).withColumn("url", F.regexp_replace("raw", r"[.,;:!?)]+$", ""))
    target = F.lower(F.coalesce("resolved_link", url))
    media = target.contains(cl.MEDIA_MARKS[0])
    for mark in cl.MEDIA_MARKS[1:]:
        media = media | target.contains(mark)
    marks = join_hot(held, links.select(F.col("link").alias("url"), "resolved_link"), ["url"], "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.when(media, "media").otherwise("link").alias("mark")))).alias("_m")
    )
    pieces = F.split(F.col(text), r"https?://[^\s]+", -1)
    glued = F.array_join(F.flatten(F.zip_with(pieces, F.col("_m"), lambda p, m: F.array(p, F.coalesce(m["mark"], F.lit(""))))), "")
    return df.join(marks, key, "left").withColumn(
        out, F.when(F.col("_m").isNull(), F.col(text)).otherwise(glued)).drop("_m")


def clean_notebook(df: DataFrame, key: str, text: str, author: str | None, parent_author: str | None,
                   links: DataFrame, places: bool = False, out: str = "cleaned") -> DataFrame:
    """The notebook variant: resolved links, typed numbers, optional place names, the long slang list.

    Adds ``out`` and ``non_ascii``, the dropped words of each text (C25).
    """
    df = df.withColumn("_t", F.col(text))
    head: list[cl.Step] = [cl.not_null, cl.transliterate, lambda c: F.translate(c, cl.STRIP_TOPICS, ""),
                           cl.strip_edges, cl.drop_retweet]
    head += [cl.drop_mention_of(F.col(a)) for a in (author, parent_author) if a]
    df = _apply(df, "_t", [[*head, cl.drop_mentions]])
    df = resolve_links(df, key, "_t", links, "_t")
    tail: list[cl.Step] = [cl.split_hashtags, cl.drop_emojis, cl.plain_quotes, cl.drop_lone_symbols, cl.mark_numbers]
    if places:
        tail.append(cl.expand_places())
    slang = cl.translate_slang(cl.SLANG_KEY_TOPICS, True, lk.NOTEBOOK_SLANG)
    df = _apply(df, "_t", [tail, [cl.typed_numbers, cl.squeeze_repeats], [slang]])
    tokens = cl.split_words(F.col("_t"))

    def final(w: Column) -> Column:
        low = F.lower(w)
        return F.when(low.isin(lk.NOTEBOOK_NEGATIONS), "not").when(low.isin(lk.STOP_WORDS), "").otherwise(
            cl.trim_topics(low))

    kept = F.filter(F.transform(cl.ascii_tokens(tokens), final), lambda w: (w != "") & ~w.isin(lk.STOP_WORDS))
    return df.withColumns({
        out: cl.tidy(cl.joined(kept)),
        "non_ascii": F.filter(tokens, lambda w: w.rlike(r"[^\x00-\x7F]")),
    }).drop("_t")


def corner_cases(df: DataFrame, key: str, text: str, cleaned: str) -> DataFrame:
    """Original, words with characters outside ASCII and cleaned text, where there are such words."""
    bad = F.filter(cl.split_words(F.col(text)), lambda w: w.rlike(r"[^\x00-\x7F]"))
    return df.select(key, F.col(text).alias("original"), F.array_join(bad, ", ").alias("non_ascii_words"), cleaned).where(
        F.col("non_ascii_words") != "")


def author_counts(df: DataFrame, author: str, is_post: Column, cleaned: str, corner: Column) -> DataFrame:
    """Non-empty cleaned posts and comments and corner cases per author."""
    full = F.col(cleaned) != ""
    return df.groupBy(author).agg(
        F.count_if(full & is_post).alias("posts"),
        F.count_if(full & ~is_post).alias("comments"),
        F.count_if(corner).alias("corner_cases"),
    )

"""Behavioural features of a comment, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtide.functions import lookups as lk
from threadtide.operators.skew import join_hot
from threadtide.session import cut_lineage

# A word character in the Unicode sense, spelled out so that it means the same in every engine.
WORD = r"[\p{L}\p{N}_]"

EMOJI = (r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}"
         r"\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}]")
# Characters that stand for an emoji of their own. The first four rows are whole blocks of pictographs, the
# rest single signs that other blocks hold among letters and symbols.
EMOJI_SIGNS = (
    r"\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{1F7E0}-\x{1F7EB}\x{1F7F0}"
    r"\x{1F004}\x{1F0CF}\x{1F170}\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F201}\x{1F202}\x{1F21A}\x{1F22F}"
    r"\x{1F232}-\x{1F23A}\x{1F250}\x{1F251}"
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{23CF}"
    r"\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2604}\x{260E}"
    r"\x{2611}\x{2614}\x{2615}\x{2618}\x{261D}\x{2620}\x{2622}\x{2623}\x{2626}\x{262A}\x{262E}\x{262F}\x{2638}-\x{263A}\x{2640}"
    r"\x{2642}\x{2648}-\x{2653}\x{265F}\x{2660}\x{2663}\x{2665}\x{2666}\x{2668}\x{267B}\x{267E}\x{267F}\x{2692}-\x{2697}\x{2699}"
    r"\x{269B}\x{269C}\x{26A0}\x{26A1}\x{26A7}\x{26AA}\x{26AB}\x{26B0}\x{26B1}\x{26BD}\x{26BE}\x{26C4}\x{26C5}\x{26C8}\x{26CE}"
    r"\x{26CF}\x{26D1}\x{26D3}\x{26D4}\x{26E9}\x{26EA}\x{26F0}-\x{26F5}\x{26F7}-\x{26FA}\x{26FD}\x{2702}\x{2705}\x{2708}-\x{270D}"
    r"\x{270F}\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}"
    r"\x{2757}\x{2763}\x{2764}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}"
    r"\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}")
TONE = r"\x{1F3FB}-\x{1F3FF}"
_UNIT = rf"[{EMOJI_SIGNS}](?:[{TONE}]|\x{{FE0F}})?"
#: One emoji as it is seen: a flag, a key cap, a tagged flag, or signs with skin tones bound by joiners.
EMOJI_SEQUENCE = (
    r"[\x{1F1E6}-\x{1F1FF}]{2}|[0-9#*]\x{FE0F}?\x{20E3}|\x{1F3F4}[\x{E0061}-\x{E007A}]+\x{E007F}|"
    rf"{_UNIT}(?:\x{{200D}}{_UNIT})*")
# A few wide ranges that hold every character an emoji starts with, but for those of key caps, and U+20E3, which
# ends every key cap. A text without any of them has no emoji.
EMOJI_HINT = r"[\x{A9}\x{AE}\x{203C}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F004}-\x{1FAFF}]"
#: EMOJI_SEQUENCE for Java, which tries every range of EMOJI_SIGNS in turn on every character: only where the hint holds.
EMOJI_FAST = rf"[0-9#*](?:\x{{20E3}}|\x{{FE0F}}\x{{20E3}})|(?={EMOJI_HINT})(?:{EMOJI_SEQUENCE})"
# The four ranges that the dashboard scorer counts.
DASHBOARD_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{2600}-\x{26FF}]"
# Links to media.
MEDIA_LINK = r"(?i)/photo/|/video/|twimg\.com|pbs\.twimg\.com"
LINK = r"https?://"
URL = r"https?://\S+"
URL_TAIL = ".,;:!?)"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _literal_count(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string; replacing is far cheaper than a pattern."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return (gone / len(needle.encode())).cast("bigint")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def emoji_count(text: Column) -> Column:
    """emojis as they are seen: a family, a flag, a key cap and a skin tone are one with what they belong to."""
    return F.when(text.rlike(EMOJI_HINT), _count(text, EMOJI_FAST)).when(text.isNotNull(), 0)


def emoticon_count(text: Column) -> Column:
    """text emoticons, every pattern counted on its own, so overlaps count more than once."""
    parts = [_literal_count(text, e) for e in lk.EMOTICONS]
    parts += [_count(text, f"(?d){p}") for p in lk.EMOTICON_PATTERNS]
    return sum(parts[1:], parts[0])


def caps_words(text: Column) -> Column:
    """words of two or more ASCII capitals and nothing else."""
    return _count(text, f"(?<!{WORD})[A-Z]{{2,}}(?!{WORD})")


def non_ascii_chars(text: Column) -> Column:
    """characters outside ASCII."""
    return F.length(F.regexp_replace(text, r"[\x00-\x7F]+", "")).cast("bigint")


def has_media_link(text: Column) -> Column:
    """F5."""
    return text.rlike(MEDIA_LINK)


def has_link(text: Column) -> Column:
    """F6."""
    return text.rlike(LINK)


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"@({WORD}+)"), F.lit(1))


def tagged_people(text: Column, *excluded: Column) -> Column:
    """mentions other than the excluded accounts, case-insensitive, duplicates counted."""
    out = F.array_compact(F.array(*[F.lower(e) for e in excluded])) if excluded else None
    found = mentions(text)
    kept = found if out is None else F.filter(found, lambda m: ~F.array_contains(out, F.lower(m)))
    return F.size(kept).cast("bigint")


def mentions_account(text: Column, account: str = "grok") -> Column:
    """F8: the account is mentioned as a whole word."""
    return text.rlike(f"(?i)@{account}(?!{WORD})")


def uses_slang(text: Column) -> Column:
    """any word of the text is a slang term. Terms with a slash can never be words."""
    return F.arrays_overlap(words(F.lower(text)), F.array(*[F.lit(t) for t in lk.SLANG_TERMS]))


def exclamations(text: Column) -> Column:
    """F10."""
    return _literal_count(text, "!")


def sentence_length(text: Column) -> Column:
    """mean number of space-separated pieces per non-blank sentence."""
    sentences = F.filter(F.split(text, r"[.!?]+"), lambda s: s.rlike(r"\S"))
    total = F.aggregate(sentences, F.lit(0), lambda acc, s: acc + F.size(F.split(s, " ")))
    return total / F.greatest(F.size(sentences), F.lit(1))


def formal_words(text: Column) -> Column:
    """connectors that mark a formal style."""
    return _count(F.lower(text), rf"(?<![A-Za-z0-9_])(?:{'|'.join(lk.FORMAL_WORDS)})(?![A-Za-z0-9_])")


def long_enough(text: Column, least: int = 40) -> Column:
    """eligible for detection."""
    return F.length(text) >= least


def _keyword_score(lower: Column, keywords: Sequence[str], weight: float, start: float = 0.0) -> Column:
    score = F.lit(start)
    for w in keywords:
        score = score + F.when(lower.contains(w), F.lit(weight)).otherwise(F.lit(0.0))
    return score


def rule_scores(df: DataFrame, text: str) -> DataFrame:
    """rule-based sentiment, hate, offence, machine and rage scores of a text column."""
    c, low = F.col(text), F.lower(F.col(text))
    base = df.withColumns({
        "_hate": _keyword_score(low, lk.HATE_WORDS, 0.15),
        "_offensive": _keyword_score(low, lk.OFFENSIVE_WORDS, 0.1),
        "_positive": _keyword_score(low, lk.POSITIVE_WORDS, 0.1),
        "_machine": _keyword_score(low, lk.MACHINE_PHRASES, 0.15, 0.7),
        "_length": sentence_length(c),
        "_formal": formal_words(c),
        "_caps": _count(c, "[A-Z]{2,}"),
        "_marks": exclamations(c),
    })
    loud, marks = F.col("_caps") > 2, F.col("_marks")
    raised = base.withColumns({
        "_hate": F.col("_hate") + F.when(loud, 0.1).otherwise(0.0),
        "_offensive": F.col("_offensive") + F.when(loud, 0.1).otherwise(0.0)
        + F.when(marks > 2, F.lit(0.05) * marks).otherwise(0.0),
        "_machine": F.col("_machine")
        + F.when(F.col("_length") > 25, 0.1).otherwise(0.0)
        + F.when(F.col("_length") > 35, 0.15).otherwise(0.0)
        + F.least(F.lit(0.2), F.col("_formal") * F.lit(0.05)),
    })
    hate, offensive, positive = F.col("_hate"), F.col("_offensive"), F.col("_positive")
    negative = (hate > 0.2) | (offensive > 0.2)
    prob = (
        F.when(negative, F.lit(0.7) + F.least(F.lit(0.25), hate + offensive))
        .when(positive > 0.1, F.lit(0.6) + positive)
        .otherwise(F.lit(0.6))
    )
    return raised.select(
        *df.columns,
        F.when(negative, "negative").when(positive > 0.1, "positive").otherwise("neutral").alias("sentiment"),
        F.least(F.lit(0.99), prob).alias("sentiment_prob"),
        F.least(F.lit(0.95), hate).alias("hate_prob"),
        F.least(F.lit(0.95), offensive).alias("offensive_prob"),
        F.least(F.lit(0.95), F.col("_machine")).alias("ai_prob"),
        F.least(F.lit(1.0), hate + offensive + F.col("_caps") * F.lit(0.05) + marks * F.lit(0.02)).alias("rage_index"),
        _count(c, DASHBOARD_EMOJI).alias("emojis"),
        F.col("_caps").alias("caps"),
        has_link(c).alias("links"),
    )


def urls(text: Column) -> Column:
    """links with trailing punctuation stripped."""
    found = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))


def digit_words(text: Column) -> Column:
    """words that hold a digit."""
    return F.filter(words(text), lambda w: w.rlike(r"\p{Nd}"))


def with_emoji_names(df: DataFrame, key: str, text: str, names: DataFrame, out: str) -> DataFrame:
    """emojis replaced by " emo-<name>- ", then every underscore by a blank; names has (emoji, name) rows.

    A sequence without a name of its own takes the names of its signs, joined by underscores; one with an unnamed sign
    stays. Only texts with an emoji are taken apart; their pieces are put back together by position. The emojis are a
    written stage: they are read several times, the texts once.
    """
    pieces = F.split(F.col(text), EMOJI_FAST)
    found = F.regexp_extract_all(F.col(text), F.lit(EMOJI_FAST), F.lit(0))
    hits = cut_lineage(df.where(F.col(text).rlike(EMOJI_HINT)).select(key, F.posexplode(found).alias("pos", "emoji")))
    plain = names.select(F.regexp_replace("emoji", r"\x{FE0F}", "").alias("emoji"), "name")
    kinds = hits.select("emoji").distinct().withColumn("bare", F.regexp_replace("emoji", r"\x{FE0F}", ""))
    whole = kinds.join(plain.withColumnRenamed("emoji", "bare"), "bare", "left")
    signs = whole.where("name IS NULL").select(
        "bare", F.posexplode(F.regexp_extract_all("bare", F.lit(r"[^\x{200D}]"), F.lit(0))).alias("place", "sign"))
    parts = signs.join(plain.select(F.col("emoji").alias("sign"), F.col("name").alias("part")), "sign", "left").groupBy("bare").agg(
        F.when(F.count("part") == F.count("*"), F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("place", "part"))), lambda x: x["part"]), "_")).alias("parts"))  # the signs of one emoji
    table = whole.join(parts, "bare", "left").select("emoji", F.coalesce("name", "parts").alias("name"))
    named = join_hot(hits, table, ["emoji"], "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce(
            F.concat(F.lit(" emo-"), F.col("name"), F.lit("- ")), F.col("emoji")).alias("name")))).alias("_n")
    )
    glued = F.concat_ws("", F.flatten(F.zip_with(
        pieces, F.col("_n"), lambda p, n: F.array(F.coalesce(p, F.lit("")), F.coalesce(n["name"], F.lit(""))))))
    return df.join(named, key, "left").withColumn(
        out, F.translate(F.when(F.col("_n").isNull(), F.col(text)).otherwise(glued), "_", " ")
    ).drop("_n")


def comment_features(text: Column, post_author: Column, parent_author: Column) -> dict[str, Column]:
    """The nine behavioural columns of the comments table."""
    return {
        "num_emojis": emoji_count(text),
        "num_text_emojis": emoticon_count(text),
        "num_caps_words": caps_words(text),
        "num_unicode_chars": non_ascii_chars(text),
        "contains_media": has_media_link(text),
        "contains_link": has_link(text),
        "num_tagged_people": tagged_people(text, post_author, parent_author),
        "tagged_grok": mentions_account(text),
        "used_slang": uses_slang(text),
    }

"""Text features and cleaning over the social posts built from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtide.functions import clean as cl
from threadtide.functions import lookups as lk
from threadtide.functions import text as tx
from threadtide.operators import cleaning, quality
from threadtide.plans import sqlclean as sq
from threadtide.plans.registry import query
from threadtide.plans.views import social_text, st_sql, table

W = r"[\p{L}\p{N}_]"


def _feature(name: str, sql: str, build, out: str = "n"):
    """Register one feature of the social text as (doc_id, out)."""
    @query(name, st_sql(f"SELECT doc_id, {sql} AS {out} FROM st"))
    def _(spark, sf):
        return social_text(spark, sf).select("doc_id", build(F.col("content"), F.col("author")).alias(out))


_feature("F1_emoji_count", f"len(regexp_extract_all(content, '{tx.EMOJI_SEQUENCE}'))", lambda c, a: tx.emoji_count(c))
_feature("F2_emoticon_count", " + ".join(
    f"CAST((strlen(content) - strlen(replace(content, {sq.quoted(e)}, ''))) / {len(e.encode())} AS BIGINT)" for e in lk.EMOTICONS
) + " + " + " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in lk.EMOTICON_PATTERNS),
    lambda c, a: tx.emoticon_count(c))
_feature("F3_caps_words",
         f"len(list_filter(regexp_extract_all(content, '{W}+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))",
         lambda c, a: tx.caps_words(c))
_feature("F4_non_ascii_chars", r"length(regexp_replace(content, '[\x00-\x7F]', '', 'g'))",
         lambda c, a: tx.non_ascii_chars(c))
_feature("F5_media_link", r"regexp_matches(content, '(?i)/photo/|/video/|twimg\.com')",
         lambda c, a: tx.has_media_link(c), "media")
_feature("F6_link", "regexp_matches(content, 'https?://')", lambda c, a: tx.has_link(c), "link")
_feature("F7_tagged_people",
         f"len(list_filter(regexp_extract_all(content, '@({W}+)', 1), lambda m: lower(m) <> lower(author)"
         f" AND lower(m) <> 'acct1'))",
         lambda c, a: tx.tagged_people(c, a, F.lit("ACCT1")))
_feature("F8_mentions_account", f"regexp_matches(content, '(?i)@grok([^\\p{{L}}\\p{{N}}_]|$)')",
         lambda c, a: tx.mentions_account(c), "tagged_grok")
_feature("F9_uses_slang", f"list_has_any(regexp_extract_all(lower(content), '{W}+'), [" +
         ", ".join(sq.quoted(t) for t in lk.SLANG_TERMS) + "])", lambda c, a: tx.uses_slang(c), "used_slang")
_feature("F10_exclamations", "length(content) - length(replace(content, '!', ''))", lambda c, a: tx.exclamations(c))
SENTENCES = r"list_filter(string_split_regex(content, '[.!?]+'), lambda s: regexp_matches(s, '\S'))"
LENGTH = (f"coalesce(list_sum(list_transform({SENTENCES}, lambda s: len(string_split(s, ' ')))), 0) * 1e0"
          f" / greatest(len({SENTENCES}), 1)")
_feature("F11_sentence_length", f"round({LENGTH}, 9)", lambda c, a: F.round(tx.sentence_length(c), 9), "words")
FORMAL = r"len(regexp_extract_all(lower(content), '\b(however|nevertheless|therefore|thus|hence|consequently)\b'))"
_feature("F12_formal_words", FORMAL, lambda c, a: tx.formal_words(c))
_feature("F18_long_enough", "length(content) >= 40", lambda c, a: tx.long_enough(c), "eligible")


def _score_sql(keywords, weight, start="0e0"):
    return " + ".join([start] + [f"CASE WHEN contains(low, {sq.quoted(w)}) THEN {weight} ELSE 0e0 END" for w in keywords])


RULES = f"""
, f AS (SELECT doc_id, content, lower(content) AS low, {LENGTH} AS len, {FORMAL} AS formal,
        len(regexp_extract_all(content, '[A-Z]{{2,}}')) AS caps, length(content) - length(replace(content, '!', '')) AS marks
        FROM st),
g AS (SELECT *, {_score_sql(lk.HATE_WORDS, '0.15e0')} AS h0, {_score_sql(lk.OFFENSIVE_WORDS, '0.1e0')} AS o0,
      {_score_sql(lk.POSITIVE_WORDS, '0.1e0')} AS p, {_score_sql(lk.MACHINE_PHRASES, '0.15e0', '0.7e0')} AS m0 FROM f),
k AS (SELECT *, h0 + CASE WHEN caps > 2 THEN 0.1e0 ELSE 0e0 END AS h,
      o0 + CASE WHEN caps > 2 THEN 0.1e0 ELSE 0e0 END + CASE WHEN marks > 2 THEN 0.05e0 * marks ELSE 0e0 END AS o,
      m0 + CASE WHEN len > 25 THEN 0.1e0 ELSE 0e0 END + CASE WHEN len > 35 THEN 0.15e0 ELSE 0e0 END
         + least(0.2e0, formal * 0.05e0) AS m FROM g),
rs AS (SELECT doc_id, CASE WHEN h > 0.2e0 OR o > 0.2e0 THEN 'negative' WHEN p > 0.1e0 THEN 'positive' ELSE 'neutral' END AS sentiment,
  round(least(0.99e0, CASE WHEN h > 0.2e0 OR o > 0.2e0 THEN 0.7e0 + least(0.25e0, h + o) WHEN p > 0.1e0 THEN 0.6e0 + p
        ELSE 0.6e0 END), 9) AS sentiment_prob,
  round(least(0.95e0, h), 9) AS hate_prob, round(least(0.95e0, o), 9) AS offensive_prob, round(least(0.95e0, m), 9) AS ai_prob,
  round(least(1e0, h + o + caps * 0.05e0 + marks * 0.02e0), 9) AS rage_index,
  len(regexp_extract_all(content, '{tx.DASHBOARD_EMOJI}')) AS emojis, caps, regexp_matches(content, 'https?://') AS links FROM k)"""


def rule_scored(spark, sf):
    out = tx.rule_scores(social_text(spark, sf).select("doc_id", "content"), "content").drop("content")
    return out.select(*[
        F.round(f.name, 9).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in out.schema.fields])


@query("F13_rule_scores", st_sql(RULES + " SELECT * FROM rs"))
def _(spark, sf):
    return rule_scored(spark, sf)


@query("F14_urls", st_sql(r"""
SELECT doc_id, regexp_replace(u, '[.,;:!?)]+$', '') AS url
FROM (SELECT doc_id, unnest(regexp_extract_all(content, 'https?://\S+')) AS u FROM st) q"""))
def _(spark, sf):
    return social_text(spark, sf).select("doc_id", F.explode(tx.urls(F.col("content"))).alias("url"))


@query("F15_digit_words", st_sql(rf"""
SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(content, '{W}+')) AS w FROM st) q
WHERE regexp_matches(w, '\p{{Nd}}')"""))
def _(spark, sf):
    return social_text(spark, sf).select(F.explode(tx.digit_words(F.col("content"))).alias("word")).distinct()


@query("F16_alpha_tokens", """
SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS terms, coalesce(t[1], '') AS first_token
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents) q""")
def _(spark, sf):
    from threadtide.operators.vectors import alpha_tokens

    docs = table(spark, sf, "documents").select("doc_id", alpha_tokens(F.col("text")).alias("t"))
    return docs.select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("terms"),
        F.coalesce(F.try_element_at("t", F.lit(1)), F.lit("")).alias("first_token"))


@query("F17_emoji_names", st_sql("""
SELECT doc_id, replace(replace(content, '😂', ' emo-face_with_tears_of_joy- '), '_', ' ') AS named FROM st"""))
def _(spark, sf):
    names = spark.createDataFrame(lk.emoji_names(), "emoji string, name string")
    out = tx.with_emoji_names(social_text(spark, sf).select("doc_id", "content"), "doc_id", "content", names, "named")
    return out.select("doc_id", "named")


@query("F_comment_features", st_sql(rf"""
SELECT count(*) AS texts, CAST(sum(len(regexp_extract_all(content, '{tx.EMOJI_SEQUENCE}'))) AS BIGINT) AS emojis,
       CAST(sum(length(regexp_replace(content, '[\x00-\x7F]', '', 'g'))) AS BIGINT) AS unicode_chars,
       count(*) FILTER (regexp_matches(content, 'https?://')) AS with_link FROM st"""))
def _(spark, sf):
    cols = tx.comment_features(F.col("content"), F.col("author"), F.lit("acct1"))
    rows = social_text(spark, sf).select("doc_id", *[c.alias(k) for k, c in cols.items()])
    return rows.agg(F.count("*").alias("texts"), F.sum("num_emojis").alias("emojis"),
                    F.sum("num_unicode_chars").alias("unicode_chars"), F.count_if("contains_link").alias("with_link"))


# ------------------------------------------------------------------------------- C: single steps

FOLDED = sq.fold("content")


def _step(name: str, sql: str, build, folded: bool = True):
    """Register one cleaning step on transliterated text as (doc_id, cleaned)."""
    source = FOLDED if folded else "content"

    @query(name, st_sql(f", f AS MATERIALIZED (SELECT *, string_split(t, '') AS l FROM (SELECT doc_id, author, {source} AS t FROM st) z) SELECT doc_id, {sql} AS cleaned FROM f"))
    def _(spark, sf):
        start = cl.transliterate(F.col("content")) if folded else F.col("content")
        df = social_text(spark, sf).select("doc_id", "author", start.alias("t"))
        return df.select("doc_id", build(F.col("t"), F.col("author")).alias("cleaned"))


_step("C1_transliterate", "t", lambda c, a: c)
# Apostrophes are planted between word pairs so that the expansions have something to act on.
PLANT = [(r"\bis\b", "isn't"), (r"\band\b", "I'm"), (r"\bder\b", "can't"), (r"\bof\b", "they're")]
_step("C2_contractions", sq.contractions(sq.sub("t", PLANT)),
      lambda c, a: cl.expand_contractions(cl.replaced(c, PLANT)))
_step("C2_late_contractions", sq.late_contractions(sq.sub("t", [(r"\band\b", "cannot")])),
      lambda c, a: cl.late_contractions(cl.replaced(c, [(r"\band\b", "cannot")])))
_step("C3_strip_characters", sq.strip_characters("t", cl.STRIP_TOPICS),
      lambda c, a: cl.strip_characters(cl.STRIP_TOPICS)(c))
_step("C4_strip_edges", sq.sub("t", cl.EDGE_SIGNS), lambda c, a: cl.strip_edges(c))
_step("C5_drop_retweet", sq.sub("t", cl.RETWEET), lambda c, a: cl.drop_retweet(c))
_step("C6_own_mention", sq.own_mention("t", "author"), lambda c, a: cl.drop_mention_of(a)(c))
_step("C7_mentions", sq.sub("t", cl.MENTIONS), lambda c, a: cl.drop_mentions(c))
_step("C8_links", sq.sub("t", cl.LINKS), lambda c, a: cl.mark_links(c))
_step("C9_hashtags", sq.hashtags("t"), lambda c, a: cl.split_hashtags(c))
_step("C10_emojis", sq.sub("t", cl.EMOJIS), lambda c, a: cl.drop_emojis(c), folded=False)
_step("C11_quotes", sq.sub("t", cl.QUOTES), lambda c, a: cl.plain_quotes(c), folded=False)
_step("C12_lone_symbols", f"array_to_string(list_filter({sq.words('w0')}, lambda w: w NOT IN {sq.in_list(lk.LONE_SYMBOLS)}), ' ')"
      .replace("w0", "replace(t, '. ', ' • ')"),
      lambda c, a: cl.drop_lone_symbols(F.replace(c, F.lit(". "), F.lit(" • "))))
_step("C13_numbers", sq.sub("t", cl.NUMBERS + [(cl.PLAIN_NUMBER, "")]),
      lambda c, a: cl.plain_numbers("")(cl.mark_numbers(c)))
TYPED = (r"CASE WHEN NOT regexp_matches(t, '\d') THEN t ELSE regexp_replace(regexp_replace(t, '\b0*(?:19|20)\d\d\b', 'year', 'g'),"
         r" '\b\d+\b', CASE WHEN regexp_matches(t, '\d{1,2}[/-]\d{1,2}') THEN 'date'"
         r" WHEN regexp_matches(t, '\d{1,2}:\d{2}') THEN 'time' ELSE 'number' END, 'g') END")
_step("C14_typed_numbers", TYPED, lambda c, a: cl.typed_numbers(c))
_step("C15_places", r"array_to_string(list_transform(regexp_extract_all(t, '\w+|\W+'), lambda w: coalesce("
      + sq.literal_map(lk.COUNTRIES | lk.STATES) + "[upper(w)], w)), '')", lambda c, a: cl.expand_places()(c))
_step("C16_repeats", sq.repeats("l"), lambda c, a: cl.squeeze_repeats(c))
_step("C17_slang_topics", sq.slang("t", cl.SLANG_KEY_TOPICS, True),
      lambda c, a: cl.translate_slang(cl.SLANG_KEY_TOPICS, True)(c))
_step("C17_slang_lexicon", sq.slang("t", cl.SLANG_KEY_LEXICON, False),
      lambda c, a: cl.translate_slang(cl.SLANG_KEY_LEXICON, False)(c))
NEG = lk.NEGATIONS + ["in", "der"]
_step("C18_negations", f"array_to_string(list_transform({sq.words('t')}, lambda w: CASE WHEN lower(w) IN {sq.in_list(NEG)}"
      " THEN 'not' ELSE w END), ' ')", lambda c, a: cl.joined(cl.mark_negations(cl.split_words(c), NEG)))
_step("C19_stop_words", f"array_to_string(list_filter({sq.words('t')}, lambda w: lower(w) NOT IN {sq.in_list(lk.STOP_WORDS)}), ' ')",
      lambda c, a: cl.joined(cl.drop_stop_words(cl.split_words(c))))
_step("C20_ascii_tokens", f"array_to_string(list_filter({sq.words('t')}, lambda w: NOT regexp_matches(w, '[^\\x00-\\x7F]')), ' ')",
      lambda c, a: cl.joined(cl.ascii_tokens(cl.split_words(c))), folded=False)
_step("C22_trim_topics", f"array_to_string(list_transform({sq.words('t')}, lambda w: {sq.trim_topics('lower(w)')}), ' ')",
      lambda c, a: cl.joined(F.transform(cl.split_words(c), lambda w: cl.trim_topics(F.lower(w)))))
_step("C22_trim_lexicon", f"array_to_string(list_transform({sq.words('t')}, lambda w: {sq.trim_lexicon('lower(w)')}), ' ')",
      lambda c, a: cl.joined(F.transform(cl.split_words(c), lambda w: cl.trim_lexicon(F.lower(w)))))
_step("C23_tidy", sq.tidy("t"), lambda c, a: cl.tidy(c))
_step("C24_empty_text", "CASE WHEN mod(doc_id, 2) = 0 THEN '' ELSE t END",
      lambda c, a: cl.not_null(F.when(F.col("doc_id") % 2 == 1, c)))


def word_list(spark, sf):
    from threadtide.operators.vectors import alpha_tokens

    found = table(spark, sf, "documents").select(F.explode(alpha_tokens(F.col("text"))).alias("term"))
    plain = spark.createDataFrame([("follow",), ("abc",), ("great",), ("the",)], "term string")
    return found.unionAll(plain).distinct()


@query("C21_leet_repair", st_sql(f""", {sq.WORD_LIST}
tk AS (SELECT DISTINCT unnest(regexp_extract_all({FOLDED}, '\\w+')) AS token FROM st),
{sq.repair_ctes('tk')} SELECT token, repaired FROM rep WHERE repaired IS NOT NULL"""))
def _(spark, sf):
    tokens = social_text(spark, sf).select(
        F.explode(F.filter(F.regexp_extract_all(cl.transliterate(F.col("content")), F.lit(r"\w+"), F.lit(0)),
                           lambda w: w.rlike(r"\d"))).alias("token"))
    return cleaning.repair_digit_words(tokens, word_list(spark, sf))


@query("C25_corner_cases", st_sql(rf"""
SELECT doc_id, content AS original, array_to_string(bad, ', ') AS non_ascii_words, lower(content) AS cleaned
FROM (SELECT *, list_filter(string_split_regex(content, '\s+'), lambda w: regexp_matches(w, '[^\x00-\x7F]')) AS bad FROM st) q
WHERE len(bad) > 0"""))
def _(spark, sf):
    df = social_text(spark, sf).withColumn("cleaned", F.lower("content"))
    return cleaning.corner_cases(df, "doc_id", "content", "cleaned")


@query("C26_author_counts", st_sql(rf"""
SELECT author, count(*) FILTER (c <> '' AND mod(doc_id, 2) = 0) AS posts, count(*) FILTER (c <> '' AND mod(doc_id, 2) = 1) AS comments,
       count(*) FILTER (regexp_matches(content, '[^\x00-\x7F]')) AS corner_cases
FROM (SELECT *, {sq.tidy("regexp_replace(content, '[^a-z ]', '', 'g')")} AS c FROM st) q GROUP BY 1"""))
def _(spark, sf):
    df = social_text(spark, sf).withColumn("c", cl.tidy(F.regexp_replace("content", "[^a-z ]", "")))
    return cleaning.author_counts(df, "author", F.col("doc_id") % 2 == 0, "c", F.col("content").rlike(r"[^\x00-\x7F]"))


@query("CA_clean_for_topics", st_sql(sq.cleaned(
    sq.topics("content", "author"), cl.SLANG_KEY_TOPICS, True,
    f"CASE WHEN lower(w) IN {sq.in_list(lk.NEGATIONS)} THEN 'not' WHEN lower(w) IN {sq.in_list(lk.STOP_WORDS)} THEN ''"
    f" ELSE {sq.trim_topics('lower(w)')} END", f"w <> '' AND w NOT IN {sq.in_list(lk.STOP_WORDS)}")))
def _(spark, sf):
    out = cleaning.clean_for_topics(
        social_text(spark, sf), "doc_id", "content", "author", word_list(spark, sf), "cleaned")
    return out.select("doc_id", "cleaned")


@query("CB_clean_for_lexicon", st_sql(sq.cleaned(
    sq.lexicon("content", "author"), cl.SLANG_KEY_LEXICON, False, sq.trim_lexicon("lower(w)"), "w <> ''")))
def _(spark, sf):
    out = cleaning.clean_for_lexicon(
        social_text(spark, sf), "doc_id", "content", "author", word_list(spark, sf), "cleaned")
    return out.select("doc_id", "cleaned")


def link_map(spark, sf):
    """Half of the short links resolve to a photo."""
    d = F.col("doc_id")
    return social_text(spark, sf).where(d % 12 == 2).select(
        F.concat(F.lit("https://t.co/a"), d.cast("string")).alias("link"),
        F.concat(F.lit("https://pic.example/"), d.cast("string"), F.lit("/photo/1")).alias("resolved_link"))


@query("J3_link_lookup", st_sql(r"""
, u AS (SELECT doc_id, regexp_replace(u, '[.,;:!?)]+$', '') AS url
        FROM (SELECT doc_id, unnest(regexp_extract_all(content, 'https?://\S+')) AS u FROM st) q),
m AS (SELECT 'https://t.co/a' || CAST(doc_id AS VARCHAR) AS link, 'https://pic.example/' || CAST(doc_id AS VARCHAR) || '/photo/1'
      AS resolved_link FROM documents WHERE mod(doc_id, 12) = 2)
SELECT doc_id, url, coalesce(resolved_link, url) AS resolved FROM u LEFT JOIN m ON url = link"""))
def _(spark, sf):
    from threadtide.operators.joins import looked_up

    held = social_text(spark, sf).select("doc_id", F.explode(tx.urls(F.col("content"))).alias("url"))
    return looked_up(held, "url", link_map(spark, sf), "link", "resolved_link", "resolved")


@query("C8_resolved_links", st_sql(r"""
SELECT doc_id, regexp_replace(content, 'https?://[^\s]+', CASE WHEN mod(doc_id, 12) = 2 OR mod(doc_id, 6) = 4 THEN 'media'
       ELSE 'link' END, 'g') AS marked FROM st"""))
def _(spark, sf):
    out = cleaning.resolve_links(
        social_text(spark, sf).select("doc_id", "content"), "doc_id", "content", link_map(spark, sf), "marked")
    return out.select("doc_id", "marked")


@query("CN_clean_notebook")
def _(spark, sf):
    df = social_text(spark, sf).withColumn("parent_author", F.lit("acct2"))
    out = cleaning.clean_notebook(df, "doc_id", "content", "author", "parent_author", link_map(spark, sf), places=True)
    return out.select("doc_id", "cleaned", F.array_join("non_ascii", ", ").alias("non_ascii"))


# ------------------------------------------------------------------------------- Q1: validator

REASON = r"""array_to_string(list_filter([
  CASE WHEN text <> '' AND (regexp_matches(text, '[\p{Lu}\p{Lt}]') OR NOT regexp_matches(text, '\p{Ll}')) THEN 'Contains uppercase' END,
  CASE WHEN NOT regexp_matches(text, '\p{Nd}') AND regexp_matches(text, '[^\p{L}\p{N}_\s]')
       THEN 'Contains punctuation/special chars/apostrophes' END,
  CASE WHEN NOT regexp_matches(text, '\p{Nd}') AND regexp_matches(text, '^\s|\s$') THEN 'Leading/Trailing whitespace' END,
  CASE WHEN NOT regexp_matches(text, '\p{Nd}') AND regexp_matches(text, '\s{2,}') THEN 'Contains double spaces' END],
  lambda r: r IS NOT NULL), '; ')"""


@query("Q1_cleaning_errors", st_sql(rf"""
, c AS (SELECT doc_id, 'raw' AS "column", content AS text FROM st
        UNION ALL SELECT doc_id, 'plain', lower(regexp_replace(content, '[^\p{{L}} ]', '', 'g')) FROM st)
SELECT doc_id, "column", text AS original_text, {REASON} AS reason FROM c WHERE {REASON} <> ''"""))
def _(spark, sf):
    df = social_text(spark, sf).select(
        "doc_id", F.col("content").alias("raw"), F.lower(F.regexp_replace("content", r"[^a-zA-Z \p{L}]+", "")).alias("plain"))
    return quality.cleaning_errors(df, "doc_id", ["raw", "plain"])


@query("Q1_cleaning_verdict", st_sql(f"""
, c AS (SELECT content AS text FROM st)
SELECT count(*) FILTER ({REASON} <> '') AS failures, count(*) FILTER ({REASON} <> '') = 0 AS passed FROM c"""))
def _(spark, sf):
    df = social_text(spark, sf).select("doc_id", "content")
    return quality.cleaning_verdict(quality.cleaning_errors(df, "doc_id", ["content"]))

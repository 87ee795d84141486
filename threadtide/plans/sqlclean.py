"""DuckDB text of the cleaning steps, for the twins of the cleaning queries."""

from __future__ import annotations

import re

from threadtide.functions import clean as cl
from threadtide.functions import lookups as lk


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        back = re.sub(r"\$(\d)", r"\\\1", replacement)
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(back)}, 'g')"
    return expr


def fold(expr: str) -> str:
    out = f"translate({expr}, {quoted(lk.FOLD_FROM)}, {quoted(lk.FOLD_TO)})"
    for mark, plain in lk.FOLD_LONG:
        out = f"replace({out}, {quoted(mark)}, {quoted(plain)})"
    return out


def contractions(expr: str) -> str:
    return sub(expr, lk.CONTRACTIONS)


def strip_characters(expr: str, characters: str) -> str:
    return f"translate({expr}, {quoted(characters + '-')}, '')"


def own_mention(expr: str, author: str) -> str:
    return f"regexp_replace({expr}, '(?i)@' || {author} || '\\s*', '', 'g')"


def hashtags(expr: str) -> str:
    tag = r"regexp_extract(p, '^\w+')"
    spaced = sub(tag, [(r"([a-zA-Z])([0-9])", "$1 $2"), (r"([a-z])([A-Z])", "$1 $2")])
    return (f"array_to_string(list_transform(string_split({expr}, '#'), lambda p, i: CASE WHEN i = 1 THEN p "
            f"WHEN {tag} = '' THEN '#' || p ELSE lower({spaced}) || substr(p, length({tag}) + 1) END), '')")


def words(expr: str) -> str:
    return rf"list_filter(string_split_regex({expr}, '\s+'), lambda w: w <> '')"


def repeats(chars: str) -> str:
    """Runs of three and more cut to two without back-references, from a column holding the characters
    as a list; newlines never count."""
    return (f"array_to_string(list_filter(list_transform({chars}, lambda c, i: CASE WHEN i > 2 AND c <> chr(10) "
            f"AND c = {chars}[i - 1] AND c = {chars}[i - 2] THEN NULL ELSE c END), lambda c: c IS NOT NULL), '')")


def literal_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


def slang(expr: str, strip: str, keep_raw: bool, table: dict[str, str] = lk.SLANG) -> str:
    key = f"regexp_replace(lower(w), {quoted(strip)}, '', 'g')"
    return (f"array_to_string(list_transform({words(expr)}, lambda w: coalesce({literal_map(table)}[{key}], "
            f"{'w' if keep_raw else key})), ' ')")


def late_contractions(expr: str) -> str:
    key = r"regexp_replace(lower(w), '[^\w\s,.!?]', '', 'g')"
    return (f"array_to_string(list_transform({words(expr)}, lambda w: coalesce("
            f"{literal_map(lk.LATE_CONTRACTIONS)}[{key}], w)), ' ')")


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def tidy(expr: str) -> str:
    return rf"lower(trim(regexp_replace({expr}, '\s+', ' ', 'g')))"


# Words known to the leet repair: the tokens of the documents and a few plain words.
WORD_LIST = """words AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents
  UNION SELECT unnest(['follow', 'abc', 'great', 'the'])),"""


def repair_ctes(tokens: str) -> str:
    """CTEs that end in ``rep(token, repaired)`` for the digit tokens of ``tokens(token)``."""
    base = "translate(lower(token), '369', 'egg')"
    reads = ", ".join(f"replace(replace({base}, '0', '{z}'), '1', '{o}')"
                      for z, o in (("o", "i"), ("u", "i"), ("o", "one"), ("u", "one"), ("no", "i"), ("no", "one")))
    return rf"""voc AS (SELECT DISTINCT token FROM {tokens} WHERE regexp_matches(token, '\d')),
rd AS (SELECT token, generate_subscripts([{reads}], 1) AS i, unnest([{reads}]) AS candidate FROM voc),
best AS (SELECT token, arg_min(candidate, i) AS reading FROM rd WHERE candidate IN (SELECT term FROM words) GROUP BY 1),
lt AS (SELECT token, unnest(regexp_extract_all(lower(token), '[a-z]+')) AS c FROM voc),
kn AS (SELECT token, bool_and(c IN (SELECT term FROM words)) AS ok FROM lt GROUP BY 1),
rep AS (SELECT voc.token, CASE WHEN regexp_matches(voc.token, '^\d+$') THEN 'number' WHEN reading IS NOT NULL THEN reading
   WHEN ok THEN array_to_string(list_transform(regexp_extract_all(voc.token, '[A-Za-z]+|\d+'),
        lambda p: CASE WHEN regexp_matches(p, '^\d') THEN 'number' ELSE lower(p) END), ' ') END AS repaired
  FROM voc LEFT JOIN best ON voc.token = best.token LEFT JOIN kn ON voc.token = kn.token)"""


def topics(expr: str, author: str) -> str:
    t = strip_characters(contractions(fold(expr)), cl.STRIP_TOPICS)
    t = own_mention(sub(t, cl.EDGE_SIGNS + cl.RETWEET), author)
    t = hashtags(sub(t, cl.MENTIONS + cl.LINKS))
    return sub(t, cl.EMOJIS + cl.QUOTES + cl.NUMBERS + [(cl.PLAIN_NUMBER, "")])


def lexicon(expr: str, author: str) -> str:
    t = strip_characters(contractions(fold(expr)), cl.STRIP_LEXICON)
    t = own_mention(sub(t, cl.EDGE_SIGNS + cl.RETWEET), author)
    t = late_contractions(sub(hashtags(sub(t, cl.MENTIONS + cl.LINKS)), cl.EMOJIS + cl.QUOTES))
    return sub(t, cl.NUMBERS + [(cl.PLAIN_NUMBER, "number")])


def trim_topics(w: str) -> str:
    return sub(w, [(r"^[^\w]+|[^\w]+$", ""), (r"[^\w\s-]", "")])


def trim_lexicon(w: str) -> str:
    return sub(w, [(r"^[^\w.,!?]+|[^\w.,!?]+$", ""), (r"[^\w\s\-,.!?]", "")])


def cleaned(start: str, slang_key: str, keep_raw: bool, final: str, keep: str, source: str = "st") -> str:
    """The whole variant: (doc_id, cleaned), from ``start`` (SQL up to the plain numbers) on."""
    ascii_words = r"lambda w: w <> '' AND NOT regexp_matches(w, '[^\x00-\x7F]')"
    return rf""", {WORD_LIST}
s1 AS MATERIALIZED (SELECT doc_id, string_split({start}, '') AS l FROM {source}),
s2 AS MATERIALIZED (SELECT doc_id, {repeats('l')} AS t FROM s1),
s3 AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex({slang('t', slang_key, keep_raw)}, '\s+'), {ascii_words}) AS ws FROM s2),
tk AS MATERIALIZED (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS token FROM s3),
{repair_ctes('tk')},
r1 AS (SELECT doc_id, pos, CASE WHEN regexp_matches(tk.token, '\d') THEN coalesce(repaired, '') ELSE tk.token END AS v
       FROM tk LEFT JOIN rep ON tk.token = rep.token),
r2 AS (SELECT doc_id, pos, generate_subscripts(string_split(v, ' '), 1) AS p2, unnest(string_split(v, ' ')) AS w FROM r1),
r3 AS (SELECT doc_id, pos, p2, {final} AS w FROM r2 WHERE w <> ''),
r4 AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos, p2) AS c FROM r3 WHERE {keep} GROUP BY 1)
SELECT s1.doc_id, coalesce({tidy('c')}, '') AS cleaned FROM s1 LEFT JOIN r4 ON s1.doc_id = r4.doc_id"""

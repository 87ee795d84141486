"""Text cleaning: one column function per step, composed in order by the two live variants.

After ``transliterate`` the text is ASCII but for letters of other scripts, whose tokens are dropped later.
Steps that look words up (leet repair) need a join and live in ``threadtide.operators.cleaning``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadtide.functions import lookups as lk
from threadtide.functions import text as tx

Step = Callable[[Column], Column]

# Characters stripped by the topic (A) and the lexicon (B) variant, besides every hyphen.
STRIP_TOPICS = "()[]{}!?|*~`^<>¡•"
STRIP_LEXICON = "()[]{}|*~`^<>¡•"

# Patterns of the single steps, as (pattern, replacement).
EDGE_SIGNS = [(r"\b[-+=_]+", ""), (r"[-+=_]+\b", "")]
RETWEET = [(r"(?i)^RT\s+@\w+:\s*", "")]
MENTIONS = [(r"^(@\w+\s*)+", ""), (r"@\w+", "tag")]
LINKS = [(r"https?://[^\s]*(?:/photo/|/video/|twimg\.com)[^\s]*", "media"), (r"https?://[^\s]+", "link")]
QUOTES = [("[’`ʼ´‘]", "'"), ("[“”„‟]", '"'),
          ("[—–‐]", "-"), (r"\x{2026}|\.{2,}", " "), ("[\"']", "")]
ELLIPSES = [(r"\x{2026}", " "), (r"\.{2,}", " ")]
DASHES, QUOTE_SIGNS = "—–‐", "’`ʼ´‘“”„‟\"'"
NUMBERS = [(r"\b\d+\.?\d*[kmbtKMBT]\b", "number"), (r"\b\d{1,3}(,\d{3})+(\.\d+)?\b", "number"),
           (r"\b\d+(st|nd|rd|th)\b", "number")]
PLAIN_NUMBER = r"\b\d+\b"
REPEATS = [(r"(.)\1{2,}", "$1$1")]
EMOJIS = [(tx.EMOJI + r"[\x{FE0F}\x{200D}\x{1F3FB}-\x{1F3FF}]*", "")]
MEDIA_MARKS = ("/photo/", "/video/", "/status/", "twimg.com")


def replaced(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def not_null(c: Column) -> Column:
    """Missing text is empty text."""
    return F.coalesce(c, F.lit(""))


def spelled(c: Column, letters: dict[str, str] | None = None) -> Column:
    """Letters of other scripts in ASCII spelling, one by one, by a table (``lookups.script_letters`` and, e.g. for Han
    readings, what the caller adds). Looked at only in texts that hold such letters."""
    table = lk.script_letters() | (letters or {})
    extra = "".join(f"\\x{{{ord(k):X}}}" for k in letters or {})
    spelling = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    one = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(spelling, x), x)), "")
    return F.when(c.rlike(f"{lk.SCRIPTS[:-1]}{extra}]"), one).otherwise(c)


def transliterate(c: Column) -> Column:
    """Letters to ASCII. Other scripts first; of Latin, one-to-one letters in a single pass, longer forms only where
    present."""
    out = F.translate(spelled(c), lk.FOLD_FROM, lk.FOLD_TO)
    for mark, plain in lk.FOLD_LONG:
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return F.when(c.rlike(r"[^\x00-\x7F]"), out).otherwise(c)


def expand_contractions(c: Column) -> Column:
    """The dictionary expansion; a text without an apostrophe is left alone."""
    return F.when(F.instr(c, "'") > 0, replaced(c, lk.CONTRACTIONS)).otherwise(c)


def late_contractions(c: Column) -> Column:
    """The map applied once quotes are gone, by punctuation-stripped word."""
    return joined(F.transform(split_words(c), lambda w: looked_up(
        F.regexp_replace(F.lower(w), r"[^\w\s,.!?]", ""), lk.LATE_CONTRACTIONS, w)))


def strip_characters(characters: str) -> Step:
    """Drop the characters and every hyphen."""
    return lambda c: F.translate(c, characters + "-", "")


def strip_edges(c: Column) -> Column:
    """C4: signs at the edges of words."""
    return replaced(c, EDGE_SIGNS)


def drop_retweet(c: Column) -> Column:
    """C5."""
    return replaced(c, RETWEET)


def drop_mention_of(author: Column) -> Step:
    """Mentions of one account, also where it only is the beginning of a longer name."""
    pattern = F.concat(F.lit(r"(?i)@\Q"), author, F.lit(r"\E\s*"))
    return lambda c: F.when(
        F.coalesce(author, F.lit("")) != "", F.regexp_replace(c, pattern, F.lit(""))
    ).otherwise(c)


def drop_mentions(c: Column) -> Column:
    """Leading mentions go, others become ``tag``."""
    return replaced(c, MENTIONS)


def mark_links(c: Column) -> Column:
    """Links become ``media`` or ``link``."""
    return replaced(c, LINKS)


def split_hashtags(c: Column) -> Column:
    """``#BreakingNews2`` becomes ``breaking news 2``."""
    parts = F.split(c, "#", -1)

    def spelled(part: Column, i: Column) -> Column:
        tag = F.regexp_extract(part, r"^\w+", 0)
        spaced = F.regexp_replace(F.regexp_replace(tag, r"([a-zA-Z])([0-9])", "$1 $2"), r"([a-z])([A-Z])", "$1 $2")
        rest = F.substr(part, F.length(tag) + 1)
        return F.when(i == 0, part).when(tag == "", F.concat(F.lit("#"), part)).otherwise(
            F.concat(F.lower(spaced), rest))

    return F.when(F.instr(c, "#") > 0, F.array_join(F.transform(parts, spelled), "")).otherwise(c)


def drop_emojis(c: Column) -> Column:
    """C10."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), replaced(c, EMOJIS)).otherwise(c)


def plain_quotes(c: Column) -> Column:
    """C11: quotes, dashes and ellipses to ASCII; quotes then dropped. All of ``QUOTES``, single characters in one pass."""
    return F.translate(replaced(c, ELLIPSES), DASHES + QUOTE_SIGNS, "-" * len(DASHES))


def split_words(c: Column) -> Column:
    """Tokens between blanks, as a whitespace split without empty ends."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def drop_lone_symbols(c: Column) -> Column:
    """Bullets and arrows that are a token of their own."""
    return joined(F.filter(split_words(c), lambda w: ~w.isin(lk.LONE_SYMBOLS)))


def mark_numbers(c: Column) -> Column:
    """Suffixed, comma-grouped and ordinal numbers become ``number``."""
    return replaced(c, NUMBERS)


def plain_numbers(replacement: str) -> Step:
    """What is left of plain digits is deleted (A) or becomes ``number`` (B)."""
    return lambda c: F.regexp_replace(c, PLAIN_NUMBER, replacement)


def typed_numbers(c: Column) -> Column:
    """C14: 1900-2099 become ``year``; other numbers take the type the whole text suggests."""
    years = F.regexp_replace(c, r"\b0*(?:19|20)\d\d\b", "year")
    kind = (
        F.when(c.rlike(r"\d{1,2}[/-]\d{1,2}"), "date").when(c.rlike(r"\d{1,2}:\d{2}"), "time").otherwise("number")
    )
    return F.when(c.rlike(r"\d"), F.regexp_replace(years, F.lit(PLAIN_NUMBER), kind)).otherwise(c)


def looked_up(key: Column, table: dict[str, str], default: Column) -> Column:
    """Value of a small dictionary. The hash test of ``isin`` keeps the map off the common path."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(key.isin(list(table)), F.element_at(pairs, key)).otherwise(default)


def expand_places(case_sensitive: bool = False) -> Step:
    """State and country codes as whole words; states win over two-letter countries."""
    codes = lk.COUNTRIES | lk.STATES

    def step(c: Column) -> Column:
        runs = F.regexp_extract_all(c, F.lit(r"\w+|\W+"), F.lit(0))
        key = (lambda w: w) if case_sensitive else F.upper
        return F.array_join(F.transform(runs, lambda w: looked_up(key(w), codes, w)), "")

    return step


def squeeze_repeats(c: Column) -> Column:
    """Three or more equal characters become two."""
    return replaced(c, REPEATS)


def translate_slang(strip: str, keep_raw: bool, table: dict[str, str] = lk.SLANG) -> Step:
    """C17: slang by punctuation-stripped token; a miss keeps the raw token (A) or the stripped one (B)."""
    def step(c: Column) -> Column:
        # the keys of a whole text at once: what is stripped holds no blank, so they stay in line with the tokens
        c = F.regexp_replace(c, r"\s+", " ")
        tokens, keys = (F.split(x, " ", -1) for x in (c, F.regexp_replace(F.lower(c), strip, "")))
        return joined(F.zip_with(tokens, keys, lambda w, k: F.when(w != "", looked_up(k, table, w if keep_raw else k))))

    return step


SLANG_KEY_TOPICS = r"[^\w\s-]"
SLANG_KEY_LEXICON = r"[^\w\s,.!?]"


def ascii_tokens(tokens: Column) -> Column:
    """C20: tokens without any character outside ASCII."""
    return F.filter(tokens, lambda w: ~w.rlike(r"[^\x00-\x7F]"))


def mark_negations(tokens: Column, negations: Sequence[str] = lk.NEGATIONS) -> Column:
    """Negations become ``not``."""
    return F.transform(tokens, lambda w: F.when(F.lower(w).isin(list(negations)), "not").otherwise(w))


def drop_stop_words(tokens: Column) -> Column:
    """C19."""
    return F.filter(tokens, lambda w: ~F.lower(w).isin(lk.STOP_WORDS))


def trim_topics(w: Column) -> Column:
    """C22 (A): marks at the edges, then all marks but hyphens."""
    return F.regexp_replace(F.regexp_replace(w, r"^[^\w]+|[^\w]+$", ""), r"[^\w\s-]", "")


def trim_lexicon(w: Column) -> Column:
    """C22 (B): the same, keeping ``. , ! ?``."""
    return F.regexp_replace(F.regexp_replace(w, r"^[^\w.,!?]+|[^\w.,!?]+$", ""), r"[^\w\s\-,.!?]", "")


def tidy(c: Column) -> Column:
    """Single blanks, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


# ------------------------------------------------------------------------------- whole variants

def steps_topics(author: Column | None) -> list[list[Step]]:
    """Variant A up to its tokens, in groups small enough for one projection each."""
    own = [drop_mention_of(author)] if author is not None else []
    return [
        [not_null, transliterate, expand_contractions, strip_characters(STRIP_TOPICS), strip_edges, drop_retweet],
        [*own, drop_mentions, mark_links, split_hashtags],
        [drop_emojis, plain_quotes, mark_numbers, plain_numbers(""), squeeze_repeats],
        [translate_slang(SLANG_KEY_TOPICS, keep_raw=True)],
    ]


def steps_lexicon(author: Column | None) -> list[list[Step]]:
    """Variant B up to its tokens."""
    own = [drop_mention_of(author)] if author is not None else []
    return [
        [not_null, transliterate, expand_contractions, strip_characters(STRIP_LEXICON), strip_edges, drop_retweet],
        [*own, drop_mentions, mark_links, split_hashtags],
        [drop_emojis, plain_quotes, late_contractions, mark_numbers, plain_numbers("number"), squeeze_repeats],
        [translate_slang(SLANG_KEY_LEXICON, keep_raw=False)],
    ]


def topic_tokens(tokens: Column) -> Column:
    """Variant A, last part, for tokens whose digit words are already repaired."""
    def final(w: Column) -> Column:
        low = F.lower(w)
        return F.when(low.isin(lk.NEGATIONS), "not").when(low.isin(lk.STOP_WORDS), "").otherwise(trim_topics(low))

    cleaned = F.transform(tokens, final)
    return F.filter(cleaned, lambda w: (w != "") & ~w.isin(lk.STOP_WORDS))


def lexicon_tokens(tokens: Column) -> Column:
    """Variant B, last part."""
    return F.filter(F.transform(tokens, lambda w: trim_lexicon(F.lower(w))), lambda w: w != "")

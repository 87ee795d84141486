"""How far the sources of a language differ in their words, with late materialisation of strings.

Terms are runs of ASCII letters and characters above U+007F, A-Z lower-cased. Shuffles carry 64-bit digests of
terms, never the terms, and numbers for languages and groups:

1. documents per (lang, digest), summed in the tasks first; digests in enough documents are kept. A digest that
   two terms share counts at least the documents of either, so no term is lost here.
2. A bitmap of the kept digests, ``MOST_BITS`` bits at most, goes to the tasks of two more passes over the texts:
   one counts occurrences per (lang, source, digest), one gives the smallest and the largest term of each digest,
   each term once a task. What the bitmap lets through by chance falls in the joins with the kept digests.
3. Where smallest and largest differ, terms share a digest: these few are counted again by their text and judged
   each for itself.
4. All sums, shares and ranks are of digests; text is joined to the rows that can be among the best only.

Sums over all kept terms for pairs of sources are taken in numpy over blocks of terms, each block with the
groups of its language; pairs are made once per block and not per term. Shares are exact whole numbers.

Edge cases: NULL text, lang and source are empty strings; a text without terms still makes its group; without kept
terms all pairs have value 0 and there are no term rows; a language with one source has no pair rows; repeated rows
are documents of their own; texts of any length are read whole; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtide.llm import textnum as tn
from threadtide.session import cut_lineage

LEAST_DOCS, SMOOTHING, SCALE_STEPS, TOP = 30, 5, 3, 50  # shares are in units of 1000 ** -SCALE_STEPS
BLOCK_BYTES, BLOCK_ROWS, LEAST_BLOCKS, TILE = 1 << 21, 1 << 15, 32, 1 << 20
LEAST_BITS, MOST_BITS, TERMS_HELD, BATCH_ROWS = 1 << 16, 1 << 27, 1 << 19, 1 << 15
TERM = np.full(256, 32, np.uint8)  # every other byte parts terms
TERM[97:123], TERM[65:91], TERM[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
KEYS = ["lang", "source", "digest"]


def _digests(block: tn.Block, bits: int) -> np.ndarray:
    return (block.word_hashes() >> np.uint64(64 - bits)).view(np.int64)


def _tally(code: np.ndarray, value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per (code, value): code, value, how often, in how many rows. ``row`` ascends."""
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(code[order], kind="stable")]
    code, value, row = code[order], value[order], row[order]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (value[1:] != value[:-1])
    fresh = first.copy()
    fresh[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(code)))
    docs = np.add.reduceat(fresh, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    return code[at], value[at], n, docs


def _read(docs: DataFrame, salt: int = 0) -> DataFrame:
    """``lang``, ``source``, ``text`` without NULLs, and numbers ``l`` and ``g`` for the language and the group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.withColumns({"l": F.xxhash64(F.lit(salt), "lang"), "g": F.xxhash64(F.lit(salt), "lang", "source")})


def _groups(docs: DataFrame) -> tuple[DataFrame, int]:
    """Every (lang, source) with its numbers, and the salt of the numbers: the first under which all differ."""
    bare = docs.select("lang", "source", F.lit("").alias("text"))
    salt = 0
    while True:
        groups = cut_lineage(_read(bare, salt).select("lang", "source", "l", "g").distinct())
        n = groups.agg(F.count("*"), F.countDistinct("g"), F.countDistinct("lang"), F.countDistinct("l")).first()
        if n[0] == n[1] and n[2] == n[3]:
            return groups, salt
        salt += 1


def _numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A small number for each row of a column of numbers, and the numbers they stand for."""
    values, of = np.unique(column.to_numpy(), return_inverse=True)
    return of.astype(np.int32), values


def _batches(columns: dict[str, np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    """The columns in batches of bounded size."""
    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
    for low in range(0, whole.num_rows, BATCH_ROWS):
        yield whole.slice(low, BATCH_ROWS)


def document_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``l``, ``digest``, ``docs``: documents of the language that hold a term of this digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, langs = _numbered(batch.column(0))
            for low, high, block in tn.blocks(batch.column(1), BLOCK_BYTES, TERM):
                row = block.row_of_words()
                code, digest, _, docs = _tally(of[low:high][row], _digests(block, bits), row)
                yield from _batches({"l": langs[code], "digest": digest, "docs": docs})

    parts = docs.select("l", "text").mapInArrow(run, "l long, digest long, docs long")
    return parts.groupBy("l", "digest").agg(F.sum("docs").alias("docs"))


def bitmap(digests: DataFrame) -> np.ndarray:
    """Bytes of a bitmap set at every digest modulo its length; ``MOST_BITS`` / 8 bytes at most, however many digests."""
    size, n = LEAST_BITS, digests.count()
    while size < min(16 * n, MOST_BITS):
        size *= 2
    slot = F.pmod("digest", F.lit(size))
    parts = digests.groupBy(F.shiftright(slot, 15).alias("bucket")).agg(
        F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros((size >> 15, 1 << 12), np.uint8)
    for bucket, bits in parts.collect():
        out[bucket] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _among(digest: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = digest & (len(bits) * 8 - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def group_counts(docs: DataFrame, some: np.ndarray, bits: int, split: bool) -> DataFrame:
    """Counts of the terms whose digest ``some`` lets through: ``l``, ``g``, ``digest``, ``n``, ``docs``; with ``split`` by
    term as well as by digest, in a column ``term`` more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, groups = _numbered(batch.column(1))
            langs = np.zeros(len(groups), np.int64)
            langs[of] = batch.column(0).to_numpy()
            for low, high, block in tn.blocks(batch.column(2), BLOCK_BYTES, TERM):
                digest = _digests(block, bits)
                hit = np.flatnonzero(_among(digest, some))
                if not len(hit):
                    continue
                row, digest = block.row_of_words()[hit], digest[hit]
                value, text = digest, None
                if split:
                    texts = block.words(hit).dictionary_encode()
                    value, text = texts.indices.to_numpy(), texts.dictionary.cast(pa.string())
                    digest = digest[np.unique(value, return_index=True)[1]]
                code, value, n, docs = _tally(of[low:high][row], value, row)
                columns = {"l": langs[code], "g": groups[code], "digest": digest[value] if split else value, "n": n, "docs": docs}
                yield from _batches(columns | ({"term": text.take(pa.array(value))} if split else {}))

    schema = "l long, g long, digest long, n long, docs long" + ", term string" * split
    parts = docs.select("l", "g", "text").mapInArrow(run, schema)
    return parts.groupBy("l", "g", "digest", *["term"] * split).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def digest_texts(docs: DataFrame, some: np.ndarray, bits: int) -> DataFrame:
    """``digest``, ``low``, ``high``: the smallest and the largest term of every digest that ``some`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, terms, rows = [], [], 0  # of this task, each term once when they are handed on

        def handed() -> Iterator[pa.RecordBatch]:
            texts = pa.concat_arrays(terms).dictionary_encode()
            first = np.unique(texts.indices.to_numpy(), return_index=True)[1]
            yield from _batches({"digest": np.concatenate(digests)[first], "term": texts.dictionary.cast(pa.string())})

        for batch in batches:
            for _, _, block in tn.blocks(batch.column(0), BLOCK_BYTES, TERM):
                digest = _digests(block, bits)
                hit = np.flatnonzero(_among(digest, some))
                texts = block.words(hit).dictionary_encode()
                digests.append(digest[hit][np.unique(texts.indices.to_numpy(), return_index=True)[1]])
                terms.append(texts.dictionary)
                rows += len(texts.dictionary)
                if rows > TERMS_HELD:
                    yield from handed()
                    digests, terms, rows = [], [], 0
        if rows:
            yield from handed()

    parts = docs.select("text").mapInArrow(run, "digest long, term string")
    return parts.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lang``, ``source``, ``digest``, ``term``, ``n`` of the kept terms that occur in a group; ``digest``, ``text``; and
    every ``lang``, ``source``. ``term`` is NULL but for the terms that share a digest with another one."""
    groups, salt = _groups(docs)
    docs = _read(docs, salt)
    known = cut_lineage(document_counts(docs, bits).where(F.col("docs") >= least_docs).select("l", "digest"))
    some = bitmap(known)
    texts = cut_lineage(digest_texts(docs, some, bits).join(known.select("digest").distinct(), "digest"))
    mixed = cut_lineage(texts.where("low <> high").select("digest"))
    clean = group_counts(docs, some, bits, split=False).join(known, ["l", "digest"]).select(
        "g", "digest", F.lit(None).cast("string").alias("term"), "n")
    if not mixed.isEmpty():
        by_term = cut_lineage(group_counts(docs, bitmap(mixed), bits, split=True).join(mixed, "digest").select(
            "l", "g", "digest", "term", "n", "docs"))
        enough = by_term.groupBy("l", "digest", "term").agg(F.sum("docs").alias("all")).where(F.col("all") >= least_docs)
        again = by_term.join(enough.drop("all"), ["l", "digest", "term"]).select("g", "digest", "term", "n")
        clean = clean.join(mixed, "digest", "left_anti").select("g", "digest", "term", "n").unionByName(again)
    counts = cut_lineage(clean.join(groups.drop("l"), "g").select(*KEYS, "term", "n"))
    return counts, texts.where("low = high").select("digest", F.col("low").alias("text")), groups.select("lang", "source")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total) by long division, so that nothing leaves 63 bits below a total of 9 * 10^15."""
    out, rest = np.zeros_like(count + total), count + 0 * total
    for _ in range(SCALE_STEPS):
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return out + 1


def _share(count: Column, total: Column) -> Column:
    """``share`` as an expression."""
    out, rest = F.lit(0).cast("bigint"), count
    for _ in range(SCALE_STEPS):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = rest * 1000 % total
    return out + 1


def _pair_sums(groups: pa.Table, terms: pa.Table) -> pa.Table:
    """Of one language and block of terms: the summed difference of every ordered pair of sources."""
    source, total = np.array(groups.column("source").to_pylist(), object), groups.column("total").to_numpy()
    order = np.argsort(source)
    source, total = source[order], total[order]
    out = np.zeros((len(source), len(source)), np.int64)
    frame = terms.select(["digest", "term"]).to_pandas()
    of = frame.groupby(["digest", "term"], dropna=False, sort=False).ngroup().to_numpy()
    place = np.argsort(of, kind="stable")
    of, at = of[place], np.searchsorted(source, np.array(terms.column("source").to_pylist(), object))[place]
    p = share(terms.column("n").to_numpy()[place] + SMOOTHING, total[at]) if len(of) else np.zeros(0, np.int64)
    rows = max(1, TILE // max(1, len(source)))
    for low in range(0, int(of[-1]) + 1 if len(of) else 0, rows):
        a, b = np.searchsorted(of, [low, low + rows])
        table = np.tile(share(np.full(len(total), SMOOTHING), total), (int(of[b - 1]) + 1 - low, 1))
        table[of[a:b] - low, at[a:b]] = p[a:b]
        for i in range(len(source)):
            out[i] += np.abs(table - table[:, i : i + 1]).sum(axis=0)
    i, j = np.nonzero(~np.eye(len(source), dtype=bool))
    return pa.table({"lang": pa.array([groups.column("lang")[0].as_py()] * len(i), pa.string()), "source": pa.array(source[i], pa.string()),
                     "item": pa.array(source[j], pa.string()), "value": pa.array(out[i, j])})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``. Part ``pair``: every other source of the language
    by the summed difference of their shares; part ``term``: the ``top`` terms whose share lies most above the language's."""
    counts, texts, named = kept_counts(docs, least_docs, bits)
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    terms_of = counts.select("lang", "digest", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = cut_lineage(
        named.join(terms_of.join(of_lang, "lang"), "lang", "left").join(sizes, ["lang", "source"], "left")
        .select("lang", "source",
                # 1 instead of 0 where nothing is kept, and so nothing is divided
                F.greatest(F.coalesce("group_n", F.lit(0)) + SMOOTHING * F.coalesce("kept", F.lit(0)), F.lit(1)).alias("total"),
                F.greatest(F.coalesce("lang_n", F.lit(0)) + SMOOTHING * F.coalesce("kept", F.lit(0)), F.lit(1)).alias("lang_total")))

    n_blocks = max(LEAST_BLOCKS, -(-counts.count() // BLOCK_ROWS))
    blocked = counts.withColumn("block", F.pmod(F.xxhash64("digest", "term"), F.lit(n_blocks)).cast("int"))
    copies = groups.select("lang", "source", "total", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    sums = copies.groupBy("lang", "block").cogroup(blocked.groupBy("lang", "block")).applyInArrow(
        _pair_sums, "lang string, source string, item string, value long")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    all_of = counts.groupBy("lang", "digest", "term").agg(F.sum("n").alias("all_n"))
    same = (F.col("l.lang") == F.col("r.lang")) & (F.col("l.digest") == F.col("r.digest")) & F.col("l.term").eqNullSafe(F.col("r.term"))
    both = counts.alias("l").join(all_of.alias("r"), same).select("l.*", "all_n").join(groups, ["lang", "source"])
    above = (_share(F.col("n") + SMOOTHING, F.col("total")) - _share(F.col("all_n") + SMOOTHING, F.col("lang_total"))).alias("value")
    above = cut_lineage(both.select("lang", "source", "digest", "term", above).where("value > 0"))
    # the smallest value among the best needs no text; only rows that reach it get theirs
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    cut = above.select("lang", "source", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top).groupBy(
        "lang", "source").agg(F.min("value").alias("least"))
    close = above.join(cut, ["lang", "source"]).where("value >= least").join(texts, "digest", "left").select(
        "lang", "source", F.coalesce("term", "text").alias("item"), "value")
    best = close.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(best.where(F.col("rank") <= top))

"""The registered queries of the subpackage, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadtide.llm import additive, decontam, divergence, langid, lines, mixing, quality, quotes, sharding, simhash, spelling, substring, tokens
from threadtide.llm.registry import documents, query


@query("op1_repetition_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(documents(spark, sf_dir))


@query("op2_balanced_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(documents(spark, sf_dir))
    return placed.select("*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query("op3_training_order")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.training_order(documents(spark, sf_dir))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs)).withColumnRenamed("row", "doc_id")


@query("op5_quotation_links")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op6_simhash_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op7_benchmark_tiling")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contaminated_pairs(documents(spark, sf_dir), benchmark)


@query("op8_entropy_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select(F.col("row").alias("doc_id"), "size", "source_size", "target", taken, "copies")


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.drop_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_common_lines")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_common_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op11_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS all_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
kc AS (SELECT lang, source, term, n FROM c JOIN k USING (lang, term)),
v AS (SELECT lang, count(*) AS v, sum(all_n) AS nn FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT lang, source, sum(n) AS n FROM kc GROUP BY ALL),
s AS (SELECT lang, source, v, nn, coalesce(n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN m USING (lang, source)),
p AS (SELECT s.lang, s.source, k.term, coalesce(kc.n, 0) AS n,
      1 + (1000000000::HUGEINT * (coalesce(kc.n, 0) + 5)) // (s.n + 5 * s.v)::HUGEINT AS p,
      1 + (1000000000::HUGEINT * (k.all_n + 5)) // (s.nn + 5 * s.v)::HUGEINT AS q
      FROM s JOIN k USING (lang) LEFT JOIN kc ON kc.lang = s.lang AND kc.source = s.source AND kc.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o
QUALIFY part = 'pair' OR rank <= 50
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


@query("op12_spelling_variants", """
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT id, run, count(*) AS n FROM d GROUP BY ALL),
b AS (SELECT run, n, list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, crc),
u AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM u WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, range(1, 100000) t(i) WHERE i <= length(word)),
e AS (SELECT p.word, q.word AS near FROM x p JOIN x q ON p.rest = q.rest AND p.i = q.i AND p.word <> q.word
      UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
f AS (SELECT e.word, count(*) AS n_near, arg_min({'near': near, 'n': v.n}, (-v.n, near)) AS best FROM e JOIN v ON v.word = e.near GROUP BY ALL),
g AS (SELECT v.word, CASE WHEN best.n >= 2 * v.n THEN best.near END AS form, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
      CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n FROM v LEFT JOIN f USING (word)),
w(word, root, depth) AS (SELECT word, word, 0 FROM g UNION ALL
  SELECT w.word, g.form, depth + 1 FROM w JOIN g ON g.word = w.root WHERE g.form IS NOT NULL)
SELECT g.word, form, o.root, n, n_near, form_n FROM g JOIN (SELECT word, arg_max(root, depth) AS root FROM w GROUP BY word) o USING (word)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


@query("op13_quality_additive")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

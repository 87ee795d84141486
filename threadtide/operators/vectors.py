"""Array columns, lexicon and TF-IDF vectors, SVD, PCA and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtide.operators import lowrank
from threadtide.session import cut_lineage


def pack(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Wide columns into one array column."""
    return df.withColumn(name, F.array(*columns)).drop(*columns)


def unpack(df: DataFrame, vector: str, dims: int, prefix: str) -> DataFrame:
    """The first ``dims`` elements of an array as columns."""
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *[F.col(vector)[i].cast("double").alias(f"{prefix}{i}") for i in range(dims)])


def concat_vectors(*vectors: Column) -> Column:
    """V4: one vector from several, element types widened to double."""
    return F.concat(*[F.transform(v, lambda e: e.cast("double")) for v in vectors])


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double")))


def normalised(v: Column, dims: int) -> Column:
    """V5: L2-normalised vector; zeros for an empty, missing or all-zero one."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    return F.when(
        v.isNull() | (F.size(v) == 0) | (norm(v) == 0), zeros
    ).otherwise(F.transform(v, lambda e: e.cast("double") / norm(v)))


def mean_pool(vectors: Column, dims: int) -> Column:
    """V5: element-wise mean of the token vectors of one text."""
    total = F.aggregate(
        vectors, F.array_repeat(F.lit(0.0), dims),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")),
    )
    return F.transform(total, lambda e: e / F.size(vectors))


def distance(v: Column, centre: Sequence[float]) -> Column:
    """V6: Euclidean distance to a fixed centre."""
    c = F.array(*[F.lit(float(x)) for x in centre])
    squares = F.zip_with(v, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, e: acc + e))


def with_distances(df: DataFrame, vector: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """V6: dist_to_centroid_<i> for a handful of centres."""
    return df.withColumns({f"dist_to_centroid_{i}": distance(F.col(vector), c) for i, c in enumerate(centres)})


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V7: (x - mean) / population deviation per column; a constant column becomes 0."""
    stats = df.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).alias("s")).scalar()
    return df.withColumns({
        c: F.when(stats[f"s_{c}"] == 0, F.lit(0.0)).otherwise((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"])
        for c in columns
    })


# ------------------------------------------------------------------------------- tokens and lexicons

def alpha_tokens(text: Column) -> Column:
    """F16: runs of ASCII letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """V2: tokens of at least two word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def term_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Term counts per text. The explode feeds a map-side aggregation."""
    return df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lexicon_hits(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Hits per text and lexicon category; the lexicon has (category, term) rows."""
    counts = term_counts(df, key, alpha_tokens(F.col(text)))
    return counts.join(lexicon, "term").groupBy(key, "category").agg(F.sum("tf").alias("hits"))


def lexicon_frequencies(df: DataFrame, key: str, text: str, lexicon: DataFrame, categories: Sequence[str]) -> DataFrame:
    """V1: hits over tokens for every category, zeros where nothing hits or the text is empty."""
    hits = lexicon_hits(df, key, text, lexicon)
    wide = hits.groupBy(key).agg(*[
        F.sum(F.when(F.col("category") == c, F.col("hits"))).alias(c) for c in categories
    ])
    sized = df.select(key, F.size(alpha_tokens(F.col(text))).alias("n_tokens"))
    return sized.join(wide, key, "left").select(
        key,
        *[F.when(F.col("n_tokens") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("n_tokens")).otherwise(F.lit(0.0)).alias(c)
          for c in categories],
    )


def tfidf(df: DataFrame, key: str, text: str, features: int = 5000) -> DataFrame:
    """V2: (key, term, weight) with the most frequent terms, idf ln((1+n)/(1+df))+1 and L2-normed rows.

    Tokens are counted once, in a written stage. The vocabulary is broadcast: its limit keeps it to ``features``
    rows. A text has at most as many terms, which bounds the window its norm is taken over.
    """
    counts = cut_lineage(term_counts(df, key, word_tokens(F.col(text))))
    weights = counts.join(F.broadcast(vocabulary(df, counts, features)), "term").select(
        key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weights.select(key, "term", (F.col("w") / norm).alias("weight"))


def vocabulary(df: DataFrame, counts: DataFrame, features: int) -> DataFrame:
    """The most frequent terms with their idf, at most ``features`` rows."""
    n = df.agg(F.count("*")).scalar()
    return (
        counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
        .orderBy(F.desc("total"), "term").limit(features)
        .select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    )


def unit_rows(df: DataFrame, key: str, text: str, features: int = 5000) -> tuple[DataFrame, list[str]]:
    """The TF-IDF rows of V2 as (key, at, w): places in the returned vocabulary and weights of norm 1. Texts without a
    term of the vocabulary have no row. Only the bounded vocabulary passes through the driver."""
    counts = cut_lineage(term_counts(df, key, word_tokens(F.col(text))))
    names = vocabulary(df, counts, features).orderBy("term").collect()
    places = F.broadcast(df.sparkSession.createDataFrame(
        [(t["term"], i, float(t["idf"])) for i, t in enumerate(names)], "term string, at int, idf double"))
    cell = counts.join(places, "term").select(key, "at", (F.col("tf") * F.col("idf")).alias("w"))
    # the norm is summed beside the cells: inside the lambda it would be worked out anew for every cell of a row
    rows = cell.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("cells"),  # a vocabulary at most
                                 F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return rows.select(key, F.col("cells.at").alias("at"),
                       F.transform("cells.w", lambda w: w / F.col("_norm")).alias("w")), [t["term"] for t in names]


def svd_project(df: DataFrame, key: str, text: str, dims: int, features: int = 5000) -> tuple[DataFrame, list[float]]:
    """V3: truncated SVD of the TF-IDF rows; returns (key, lsa array) and the singular values.

    Only the bounded vocabulary and its basis (features x dims) pass through the driver.
    """
    rows, names = unit_rows(df, key, text, features)
    rows = cut_lineage(rows)
    basis, values = lowrank.axes(rows, len(names), min(dims, len(names)))
    return lowrank.projected(rows, key, basis, "lsa"), [float(x) for x in values]


def lsa_dims(categories: int) -> int:
    """V3: width of the topic vector next to a lexicon vector of that many categories."""
    return max(50, 256 - categories)


def pca_project(df: DataFrame, vector: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """V8: centred projection on the first k components and their explained variance."""
    means = [r["m"] for r in df.select(F.posexplode(vector).alias("pos", "val")).groupBy("pos")
             .agg(F.avg("val").alias("m")).orderBy("pos").collect()]  # one value per dimension
    centre = F.array(*[F.lit(float(m)) for m in means])
    centred = df.withColumn("_v", array_to_vector(F.zip_with(vector, centre, lambda a, b: a.cast("double") - b)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(centred)
    out = model.transform(centred).withColumn("pca", vector_to_array("_p")).drop("_v", "_p")
    return out, [float(x) for x in model.explainedVariance.toArray()]

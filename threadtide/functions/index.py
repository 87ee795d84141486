"""Composite indices, label encodings and banding rules, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of the lexicon score vector that the reference data carries.
LEXICON_CATEGORIES = """
help office dance money wedding domestic_work sleep medical_emergency cold hate cheerfulness aggression
occupation envy anticipation family vacation crime attractive masculine prison health pride dispute
nervousness government weakness horror swearing_terms leisure suffering royalty wealthy tourism furniture
school magic beach journalism morning banking social_media exercise night kill blue_collar_job art ridicule
play computer college optimism stealing real_estate home divine sexual fear irritability superhero business
driving pet childish cooking exasperation religion hipster internet surprise reading worship leader
independence movement body noise eating medieval zest confusion water sports death healing legend heroic
celebration restaurant violence programming dominant_heirarchical military neglect swimming exotic love
hiking communication hearing order sympathy hygiene weather anonymity trust ancient deception fabric
air_travel fight dominant_personality music vehicle politeness toy farming meeting war speaking listen urban
shopping disgust fire tool phone gain sound injury sailing rage science work appearance valuable warmth
youth sadness fun emotional joy affection traveling fashion ugliness lust shame torment economics anger
politics ship clothing car strength technology breaking shape_and_size power white_collar_job animal party
terrorism smell disappointment poor plant pain beauty timidity philosophy negotiate negative_emotion cleaning
messaging competing law friends payment achievement alcohol liquid feminine weapon children monster ocean
giving contentment writing rural positive_emotion musical
""".split()

# The categories averaged into the rage component.
RAGE_CATEGORIES = ("rage", "anger", "aggression", "irritability", "violence", "fight")


def confident(conf: Column, t: float) -> Column:
    """Two-sided confidence filter, both bounds inclusive."""
    return (conf <= F.lit(t)) | (conf >= F.lit(1 - t))


def confident_between(conf: Column, low: float, high: float) -> Column:
    """Confidence outside the open interval (low, high)."""
    return (conf >= F.lit(high)) | (conf <= F.lit(low))


def strictly_confident(conf: Column) -> Column:
    """The strict variant, above 0.9 or below 0.1."""
    return (conf > F.lit(0.9)) | (conf < F.lit(0.1))


def numeric_label(label: Column) -> Column:
    """P5: LABEL_k -> k; anything else falls back to its first run of digits."""
    return (
        F.when(label == "LABEL_0", 0)
        .when(label == "LABEL_1", 1)
        .otherwise(F.regexp_extract(label, r"(\d+)", 1).try_cast("int"))
    )


def signed_sentiment(label: Column, prob: Column) -> Column:
    """The probability signed by the label; unknown labels count as neutral."""
    return F.when(label == "positive", prob).when(label == "negative", -prob).otherwise(F.lit(0.0))


def finite_or_zero(c: Column) -> Column:
    """Q8: NULL, NaN and both infinities become 0."""
    return F.when(F.isnull(c) | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def rage_first(vector: Column) -> Column:
    """P7 (a): first element of the lexicon vector, 0 when empty."""
    return finite_or_zero(F.try_element_at(vector, F.lit(1)).cast("double"))


def rage_mean(vector: Column, positions: list[int] | None = None) -> Column:
    """P7 (b): mean of the named positions that the vector has, 0 when it has none."""
    if positions is None:
        positions = [LEXICON_CATEGORIES.index(c) for c in RAGE_CATEGORIES]
    terms = [F.try_element_at(vector, F.lit(p + 1)).cast("double") for p in positions]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    present = sum((t.isNotNull().cast("int") for t in terms), F.lit(0))
    return F.when(present > 0, total / present).otherwise(F.lit(0.0))


def rage_bait_index(rage: Column, offensive: Column, hate: Column, s: Column) -> Column:
    """(r + o + h) * (1 - |s|)."""
    return (rage + offensive + hate) * (F.lit(1.0) - F.abs(s))


def calibrated_index(rage: Column, offensive: Column, hate: Column) -> Column:
    """0.4 r + 0.3 o + 0.3 h."""
    return F.lit(0.4) * rage + F.lit(0.3) * offensive + F.lit(0.3) * hate


def with_index(df: DataFrame, rage: str = "rage") -> DataFrame:
    """Add the signed sentiment ``s`` and the index ``rbi`` to scored comments."""
    s = signed_sentiment(F.col("sentiment_label"), F.col("sentiment_prob"))
    return df.withColumn("s", s).withColumn(
        "rbi",
        rage_bait_index(F.col(rage), F.col("offensive_prob"), F.col("hate_prob"), F.col("s")),
    )


def dashboard_columns(aggression: Column, rage: Column, anger: Column, hate: Column) -> dict[str, Column]:
    """P10: toxicity, doubled and capped index, plot coordinates and colour class."""
    toxicity = (F.col("hate_prob") + F.col("offensive_prob")) / 2
    capped = F.least(F.lit(1.0), (aggression + rage + anger + hate) * 2)
    s = signed_sentiment(F.col("sentiment_label"), F.col("sentiment_prob"))
    colour = (
        F.when(F.col("hate_label") == "HATE", "red")
        .when(F.col("offensive_label") == "offensive", "orange")
        .when(F.col("sentiment_label") == "negative", "blue")
        .when(F.col("sentiment_label") == "positive", "green")
        .otherwise("gray")
    )
    return {
        "toxicity": toxicity,
        "capped_index": capped,
        "x": toxicity * 20 - 10,
        "y": capped * 15,
        "z": s * 10,
        "colour": colour,
    }


def user_status(hate_count: Column, toxicity: Column) -> Column:
    """FLAGGED on any hate, MONITOR above 0.3, else NORMAL."""
    return F.when(hate_count > 0, "FLAGGED").when(toxicity > 0.3, "MONITOR").otherwise("NORMAL")


def is_root(parent: Column, post: Column | None = None) -> Column:
    """No parent, or (literal rule) a parent equal to the post."""
    bare = parent.isNull()
    return bare if post is None else bare | F.coalesce(parent == post, F.lit(False))


def effect_size(delta: Column) -> Column:
    """Band of |delta|."""
    d = F.abs(delta)
    return (
        F.when(d < 0.147, "Negligible").when(d < 0.33, "Small").when(d < 0.474, "Medium").otherwise("Large")
    )


def effect_direction(delta: Column) -> Column:
    return F.when(delta > 0, "Bots > Humans").otherwise("Humans > Bots")


def stars(p: Column) -> Column:
    """Significance stars."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def robustness_class(pct: Column) -> Column:
    """Class of the share of significant replicates."""
    return F.when(pct >= 95, "ROBUST").when(pct >= 80, "SENSITIVE").otherwise("NOT ROBUST")


# Bins of comments per user, in report order.
COUNT_BINS = ("1", "2", "3", "4", "5-10", ">10")


def count_bin(n: Column) -> Column:
    """Bin of a user's comment count."""
    return F.when(n <= 4, n.cast("string")).when(n <= 10, "5-10").otherwise(">10")


def parse_flag(text: Column) -> Column:
    """Booleans stored as text: True, true and 1 are true, all else is false."""
    return F.coalesce(text.isin("True", "true", "1"), F.lit(False))


def number_or_zero(text: Column) -> Column:
    """Numeric text, 0 when missing or malformed."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def or_default(text: Column, default: str) -> Column:
    """A label, or its default when NULL or empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(text)

"""Declared schemas of the inputs."""

from __future__ import annotations

from pyspark.sql import types as T

COUNTERS = ("likes", "retweet", "share", "views", "replies")


#: A post, comment or reply; its own replies stay JSON text, so a thread can have any depth.
NODE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("username", "content")]
    + [T.StructField(n, T.LongType()) for n in COUNTERS]
    + [T.StructField(n, T.StringType()) for n in ("link", "replies_content")]
)
#: The JSON parser's limit on nesting, two for each level of replies.
JSON_DEPTH = {"maxNestingDepth": "1000000"}

LEANING = T.StructType([T.StructField("author_id", T.StringType()), T.StructField("leaning", T.StringType())])
LINKS = T.StructType([
    T.StructField(n, T.StringType()) for n in ("link", "resolved_link", "category", "source_file")
])

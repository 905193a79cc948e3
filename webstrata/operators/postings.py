"""Postings of a table as they come: one row per token occurrence, and what can be counted from them.

Searches use the stored form of ``index``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .groups import spread
from .query import TEXT_FIELDS

KEY = ("site", "id")


def build_postings(resources: DataFrame, key: tuple[str, ...] = KEY,
                   fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """(key..., field, token, pos) for every token of every indexed field; no shuffle."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text"))
                      for f in fields])
    per_field = spread(resources.select(*dict.fromkeys([*key, *fields]))).select(*key, F.explode(texts).alias("t"))
    return (per_field.select(*[F.col(k).alias(f"k_{k}") for k in key], F.col("t.field").alias("field"),
                             F.posexplode(tx.tokens(F.col("t.text"))).alias("pos", "token"))
            .select(*[F.col(f"k_{k}").alias(k) for k in key], "field", "token", "pos"))


def term_stats(postings: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows and occurrences per token, with the frequency bands used to pick test terms.

    The first grouping is by token and row, so a token found everywhere is summed on
    the map side before anything is grouped by token alone.
    """
    per_row = postings.groupBy("token", *key).agg(F.count("*").alias("tf"))
    stats = per_row.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    band = (F.when(F.col("df") >= 10, "common").when(F.col("df") > 3, "specific")
            .otherwise("rare"))
    return stats.withColumn("band", band)

"""Connected components of a link table that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with over any number of steps, for all linked nodes.

    ``links`` has the long columns ``a`` and ``b``.  Alternates two steps until nothing changes: every node hands the
    smallest of its neighbours and itself to its larger neighbours, then to its smaller ones.  Minima are partial
    aggregations and joins with them are split by AQE, so one node may hold any share of the links.  Each round's links
    are written to the shared folder; the driver sees two numbers per round.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = _handed(both, F.col("b") > F.col("a"), name)
        edges = _handed(larger, F.lit(True), name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())


def _handed(edges: DataFrame, which, name: str) -> DataFrame:
    """Links from the wanted neighbours ``b`` of each node ``a`` to the smallest node that ``a`` knows, itself included."""
    least = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
    out = edges.where(which).join(least, "a").select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
    return stored(out.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct(), name)

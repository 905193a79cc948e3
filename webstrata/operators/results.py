"""Shape of a search result: fields, order, paging, totals, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as N
from ..functions import text as tx
from .groups import spread
from .query import Query, search

SORTS = ("id", "url", "status", "size")


def fields(requested: list[str] | None = None) -> list[str]:
    """Base fields plus the known ones among those requested."""
    wanted = requested or []
    return S.BASE_FIELDS + [f for f in S.OPTIONAL_FIELDS if f in wanted]


def ordering(sort: str | None) -> list[Column]:
    """``+field`` or ``-field``; anything else sorts by URL.  Ties go by id."""
    name = (sort or "+url").strip("*\"'`")
    direction, key = name[:1], name[1:]
    if direction not in ("+", "-") or key not in SORTS:
        direction, key = "+", "url"
    column = F.col(key).asc() if direction == "+" else F.col(key).desc()
    return [column] if key == "id" else [column, F.col("id").asc(), F.col("site").asc()]


def page(df: DataFrame, sort: str | None = None, limit: int = S.DEFAULT_LIMIT, offset: int = 0,
         seed: int | None = None, after: dict | None = None) -> DataFrame:
    """One page of results: a top-k, not a full sort.  ``sort="?"`` draws a random page.

    An offset is gathered with the page; deep pages are cheaper with ``after``, the last row of the page before:
    its values of the sort field, ``id`` and ``site``.
    """
    limit, offset = max(1, limit), max(0, offset)
    if after is not None:
        df = df.where(_beyond(sort, after))
    keys = [F.rand(seed) if seed is not None else F.rand()] if sort == "?" else ordering(sort)
    return df.orderBy(*keys).offset(offset).limit(limit)


def _beyond(sort: str | None, row: dict) -> Column:
    """Rows that come later than ``row`` in the order of ``sort``; NULL comes first or, descending, last."""
    name = (sort or "+url").strip("*\"'`")
    direction, key = name[:1], name[1:]
    if direction not in ("+", "-") or key not in SORTS:
        direction, key = "+", "url"
    value = F.lit(row[key])
    if direction == "+":
        later = F.lit(True) & F.col(key).isNotNull() if row[key] is None else F.col(key) > value
    else:
        later = F.lit(False) if row[key] is None else F.col(key).isNull() | (F.col(key) < value)
    ties = (F.col("id") > row["id"]) | ((F.col("id") == row["id"]) & (F.col("site") > row["site"])) if key != "id" else F.lit(False)
    return later | (F.col(key).eqNullSafe(value) & ties)


def sample_by_type(df: DataFrame, fractions: dict[str, float], seed: int) -> DataFrame:
    return df.sampleBy("type", fractions, seed)


def stratified_sample(df: DataFrame, per_type: int, seed: int) -> DataFrame:
    """Exactly ``per_type`` rows of each type, or all if there are fewer: those whose seeded hash of site and id is smallest.

    The same rows for the same seed, whatever the partitions.  Each task first keeps its smallest of a type, then hash shares of a
    type keep theirs, so a frequent type is no bottleneck.
    """
    draw = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("site").cast("string"), F.col("id").cast("string")))
    drawn = df.withColumn("_draw", draw).withColumn("_share", F.substring(draw, -2, 2))
    place = lambda *by: F.row_number().over(Window.partitionBy("type", *by).orderBy("_draw", "site", "id"))
    few = drawn.withColumn("_place", place("_share")).where(F.col("_place") <= per_type)
    return few.withColumn("_place", place()).where(F.col("_place") <= per_type).select(*df.columns)


def search_page(resources: DataFrame, query: Query, requested: list[str] | None = None,
                sort: str | None = None, limit: int = S.DEFAULT_LIMIT, offset: int = 0,
                site_ids: list[int] | None = None, seed: int | None = None, after: dict | None = None) -> DataFrame:
    hits = search(resources, query, site_ids).select(*fields(requested))
    return page(hits, sort, limit, offset, seed, after)


def total(resources: DataFrame, query: Query, site_ids: list[int] | None = None) -> DataFrame:
    """Number of matching rows, as a one-row frame."""
    return search(resources, query, site_ids).agg(F.count("*").alias("total"))


def navigation(resources: DataFrame, query: Query, limit: int, offset: int,
               site_ids: list[int] | None = None) -> DataFrame:
    """Total, page number, page count and neighbours of one page."""
    n = F.col("total")
    return total(resources, query, site_ids).select(
        n, F.lit(offset // limit + 1).cast("long").alias("page"),
        F.ceil(n / limit).cast("long").alias("pages"),
        (F.lit(offset) > 0).alias("has_previous"),
        (F.lit(offset + limit) < n).alias("has_next"))


def facets(resources: DataFrame, query: Query, site_ids: list[int] | None = None) -> DataFrame:
    """Distinct sites, types and statuses of a result with their row counts."""
    hits = search(resources, query, site_ids)
    values = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in ("site", "type", "status")])
    return hits.select(F.explode(values).alias("f")).groupBy("f.field", "f.value").agg(F.count("*").alias("n"))


def with_sites(resources: DataFrame, sites: DataFrame) -> DataFrame:
    """Resource rows with the name of their site; rows of unlisted sites keep a NULL name."""
    names = sites.select(F.col("id").alias("site"), F.col("name").alias("site_name"))
    return resources.join(names, "site", "left")


def set_algebra(resources: DataFrame, pairs: list[tuple[str, str]], field: str = "content") -> DataFrame:
    """Per pair of terms: rows with either, both, one of them only, and whether the counts add up.

    One pass: the text is lower-cased once, each term tested once, each pair counted from the flags.
    """
    words = {w: f"w{i}" for i, w in enumerate(dict.fromkeys(w for p in pairs for w in p))}
    lowered = spread(resources.select(field)).select(F.lower(field).alias("low"))
    flags = lowered.select(*[F.coalesce(tx.has_tokens(F.col("low"), tx.split_tokens(w), lowered=True), F.lit(False)).alias(n)
                             for w, n in words.items()])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(words[a]).alias("x"), F.col(words[b]).alias("y"))
                     for a, b in pairs])
    x, y = F.col("x"), F.col("y")
    counts = flags.select(F.explode(rows).alias("p")).select("p.*").groupBy("a", "b").agg(
        F.count_if(x).alias("n_a"), F.count_if(y).alias("n_b"), F.count_if(x & y).alias("n_and"),
        F.count_if(x | y).alias("n_or"), F.count_if(x & ~y).alias("n_minus"))
    return counts.withColumn("holds", F.col("n_a") + F.col("n_b") == F.col("n_and") + F.col("n_or"))


def to_json(df: DataFrame, forced: list[str] | None = None) -> DataFrame:
    """One JSON object per row: NULL fields are left out, except forced ones, and times are ISO-8601."""
    def value(name: str, type_: str) -> Column:
        col = F.col(name)
        return (N.iso_zulu(col) if type_ == "timestamp" else col).alias(name)

    typed = df.select(*[value(n, t) for n, t in df.dtypes])
    forced = [f for f in (forced or []) if f in df.columns]
    whole = F.to_json(F.struct(*typed.columns), {"ignoreNullFields": "true"})
    for name in forced:
        gap = F.concat(F.lit(f'"{name}":null'), F.when(whole == "{}", F.lit("}")).otherwise(F.lit(",")))
        filled = F.concat(F.lit("{"), gap, F.substr(whole, F.lit(2)))
        whole = F.when(F.col(name).isNull(), filled).otherwise(whole)
    return typed.select(F.col("id"), whole.alias("json"))

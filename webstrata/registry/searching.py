"""Searches in scan mode and in index mode."""

from __future__ import annotations

import functools
import hashlib
import operator
import uuid

from pyspark.sql import functions as F

from ..operators import postings as P
from ..operators import query as q
from ..operators import results as R
from ..operators.groups import work_folder
from ..operators.index import Index
from ..plans import fixture
from .common import DOCUMENTS, FIELDS, has, sql

SHOWN = ["id", "url", "site", "type", "status"]
LISTED = "id, url, site, type, status"


def _pages(query, fields=None):
    return lambda spark, folder: q.search(fixture.load_pages(spark, folder), query).select(*(fields or SHOWN))


def _where(condition: str, guard: bool = True, listed: str = LISTED) -> str:
    return sql(f"SELECT {listed} FROM r WHERE ({condition})" + (" AND status >= 100" if guard else ""))


DOC_QUERY = (q.text("the") & q.field("type", "en")) | (q.phrase("of the") - q.field("site", "1")) \
    | (q.prefix("tion") & ~q.text("de"))
DOC_SQL = (f"({has('the')} AND {has('en', ('type',))}) OR ({has('of the')} AND NOT {has('1', ('site',))})"
           f" OR ({has('tion', prefix=True)} AND NOT {has('de')})")

OR_PAIRS = [("the", "de"), ("of", "la"), ("in", "que"), ("and", "und"), ("a", "en"), ("to", "el"), ("is", "der"), ("on", "les"), ("er", "ch"), ("re", "st"),
            ("th", "ie"), ("nd", "le"), ("an", "los"), ("or", "die"), ("at", "des"), ("ing", "ver"), ("ed", "eau"), ("ent", "ción"), ("sh", "ment"), ("wh", "zu")]

# saved queries by name, with the condition each must equal
SAVED = {
    "plain": (q.text("the"), has("the")),
    "all_of": (q.text("the") & q.text("of") & q.text("in"), f"{has('the')} AND {has('of')} AND {has('in')}"),
    "phrase": (q.phrase("of the"), has("of the")),
    "stem": (q.prefix("thea"), has("thea", prefix=True)),
    "minus": (q.text("de") - q.text("la"), f"{has('de')} AND NOT {has('la')}"),
    "neither": (~(q.text("the") | q.text("de")), f"NOT ({has('the')} OR {has('de')})"),
    "mixed": (q.text("und") | ((q.size > 3000) & ~q.text("the")), f"{has('und')} OR (size > 3000 AND NOT {has('the')})"),
    "typed": (q.field("type", "fr") & (q.size < 900), f"{has('fr', ('type',))} AND size < 900"),
}


def _saved(spark, folder):
    return fixture.document_index(spark, folder).search({name: query for name, (query, _) in SAVED.items()})


def _one(name: str):
    def run(spark, folder):
        return fixture.document_index(spark, folder).search({name: SAVED[name][0]})
    return run, sql(f"SELECT '{name}' AS query_id, site, id FROM r WHERE {SAVED[name][1]}", DOCUMENTS)


# forms of a query that a normal form would multiply out, long phrases, stems behind phrases, many literals
MANY = {
    "ors_and": (functools.reduce(operator.and_, (q.text(a) | q.text(b) for a, b in OR_PAIRS)), " AND ".join(f"({has(a)} OR {has(b)})" for a, b in OR_PAIRS)),
    "long_phrase": (q.phrase("of the of") | q.phrase("de la de la"), f"{has('of the of')} OR {has('de la de la')}"),
    "phrase_stem": (q.prefix("of th") - q.prefix("the the t"), f"{has('of th', prefix=True)} AND NOT {has('the the t', prefix=True)}"),
    "negated": (~(q.text("the") & ~(q.text("of") | q.text("de"))) & (q.size > 500), f"NOT ({has('the')} AND NOT ({has('of')} OR {has('de')})) AND size > 500"),
}


def _segments(merged: bool):
    """Two appends, the second of which replaces every third document of the first; searched as they are or merged."""
    def run(spark, folder):
        docs = fixture.load_documents(spark, folder)
        index = Index(spark, f"{work_folder(spark)}/webstrata/segments-{uuid.uuid4().hex}")
        stale = docs.withColumn("content", F.when(F.pmod("id", F.lit(3)) == 0, F.lit("stale of the")).otherwise(F.col("content")))
        index.append(stale).append(docs.where(F.pmod("id", F.lit(3)) == 0))
        queries = {n: SAVED[n][0] for n in ("phrase", "minus", "neither")} | {"stale": q.text("stale")}
        return (index.merge() if merged else index).search(queries)
    return run, sql(" UNION ALL ".join(f"SELECT '{n}' AS query_id, site, id FROM r WHERE {c}" for n, c in
                                       [(n, SAVED[n][1]) for n in ("phrase", "minus", "neither")] + [("stale", has("stale"))]), DOCUMENTS)


def _postings_join(spark, folder):
    """Postings with the columns of their resource, counted by type."""
    docs = fixture.load_documents(spark, folder)
    per_row = P.build_postings(docs, fields=("content",)).groupBy("site", "id").agg(F.count("*").alias("tokens"))
    return (per_row.join(docs.select("site", "id", "type"), ["site", "id"], "left")
            .groupBy("type").agg(F.sum("tokens").alias("postings"), F.count("*").alias("n")))


PAIRS = [("the", "of"), ("de", "la"), ("und", "the")]


def _pair_sql(a: str, b: str) -> str:
    x, y = has(a, ("content",)), has(b, ("content",))
    return (f"SELECT '{a}' AS a, '{b}' AS b, count_if({x})::BIGINT AS n_a, count_if({y})::BIGINT AS n_b, "
            f"count_if({x} AND {y})::BIGINT AS n_and, count_if({x} OR {y})::BIGINT AS n_or, "
            f"count_if({x} AND NOT {y})::BIGINT AS n_minus, true AS holds FROM r")


TOKENS = ("t AS (SELECT id, f.field AS field, unnest(list_filter(string_split_regex(lower(f.text), "
          r"'[^\p{L}\p{N}_-]+'), lambda x: x <> '')) AS token FROM (SELECT id, unnest(["
          + ", ".join(f"{{'field': '{f}', 'text': {f}::VARCHAR}}" for f in FIELDS) + "]) AS f FROM r))")

THREE = "(SELECT id FROM r WHERE type = 'html' AND status = 200 ORDER BY url LIMIT 3)"


def _three_ids(spark, folder):
    # ids as a user would paste them from an earlier result
    from ..functions import scalar as N
    pages = fixture.load_pages(spark, folder)
    ids = [r.id for r in R.page(pages.where("type = 'html' AND status = 200").select("id", "url", "site"), limit=3).collect()]
    return q.search(pages, (q.id == ids[0]) | (q.id == ids[1]) | (q.id == ids[2])).select(*SHOWN)


# a few hosts of the given pages, and one that none has
HOSTS = ["thther.example.org", "therha.example.com", "tionsh.example.net", "nowhere.invalid"]
SITE_IDS = [int(hashlib.sha1(h.encode()).hexdigest()[:12], 16) for h in HOSTS]


def _coded(spark, folder):
    """The pages with types as integers, as in database exports, where type names are swapped for codes."""
    pages = fixture.load_pages(spark, folder)
    code = F.when(F.col("type") == "img", 6).when(F.col("type") == "script", 11).when(F.col("type") == "style", 10).otherwise(1)
    return q.search(pages.withColumn("type", code), q.type_codes(["img", "style"])).select("id", "url", "type")


QUERIES = {
    "search_sites": (lambda spark, folder: q.search(fixture.load_pages(spark, folder), q.text("the") | q.text("de"), SITE_IDS).select(*SHOWN),
                     _where(f"({has('the')} OR {has('de')}) AND regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) IN ({', '.join(repr(h) for h in HOSTS)})")),
    "search_type_codes": (_coded, sql("SELECT id, url, CASE type WHEN 'img' THEN 6 ELSE 10 END::INT AS type FROM r WHERE type IN ('img', 'style') AND status >= 100")),
    "search_text": (_pages(q.text("and")), _where(has("and"))),
    "search_phrase": (_pages(q.phrase("of the")), _where(has("of the"))),
    "search_prefix": (_pages(q.prefix("thea")), _where(has("thea", prefix=True))),
    "search_field": (_pages(q.field("headers", "text/css") | q.field("content", "was")),
                     _where(f"{has('text css', ('headers',))} OR {has('was', ('content',))}")),
    "search_url": (_pages(q.url("*Example.org*")), _where("contains(lower(url), 'example.org')")),
    "search_numeric": (_pages(((q.status >= 400) | (q.size > 5000)) & (q.time != 7)),
                       _where("(status >= 400 OR size > 5000) AND time <> 7", False)),
    "search_and": (_pages(q.text("and") & q.text("of") & q.field("type", "html")),
                   _where(f"{has('and')} AND {has('of')} AND {has('html', ('type',))}")),
    "search_or": (_pages(q.text("and") | q.text("de")), _where(f"{has('and')} OR {has('de')}")),
    "search_not": (_pages(q.text("and") - q.text("es")), _where(f"{has('and')} AND NOT {has('es')}")),
    "search_unary_not": (_pages(~q.text("and") & q.text("de")), _where(f"NOT {has('and')} AND {has('de')}")),
    "search_nested": (_pages(q.field("type", "html") & (q.url("example.com") | (q.url("example.org") & ~q.text("la")))),
                      _where(f"type = 'html' AND (contains(url, 'example.com') OR (contains(url, 'example.org') AND NOT {has('la')}))")),
    "search_not_group": (_pages(~((q.status == 404) | (q.status == 500))),
                         _where("NOT (status = 404 OR status = 500)", False)),
    "search_or_mixed_fields": (_pages((q.status == 404) | q.text("was")), _where(f"status = 404 OR {has('was')}", False)),
    "search_three_ids": (_three_ids, _where(f"id IN {THREE}")),
    "search_documents": (lambda spark, folder: q.search(fixture.load_documents(spark, folder), DOC_QUERY).select("site", "id"),
                         sql(f"SELECT site, id FROM r WHERE {DOC_SQL}", DOCUMENTS)),
    "only_html": (_pages(q.only_html(q.text("the") | q.text("of"))),
                  _where(f"type = 'html' AND ({has('the')} OR {has('of')})")),
    "search_types": (_pages(q.types(["img", "style", "nonsense"])), _where("type IN ('img', 'style')")),
    "homepage": (lambda spark, folder: q.find_homepage(fixture.load_pages(spark, folder), "example.com").select(*SHOWN),
                 _where("type = 'html' AND contains(lower(url), 'example.com')") + " ORDER BY url, id LIMIT 1"),
    "search_total": (lambda spark, folder: R.total(fixture.load_pages(spark, folder), q.text("and")),
                     _where(has("and"), listed="count(*) AS total")),
    "set_algebra": (lambda spark, folder: R.set_algebra(fixture.load_documents(spark, folder), PAIRS),
                    sql(" UNION ALL ".join(_pair_sql(a, b) for a, b in PAIRS), DOCUMENTS)),
    "postings_build": (lambda spark, folder: P.build_postings(fixture.load_documents(spark, folder))
                       .groupBy("field", "token").agg(F.count("*").alias("n"), F.countDistinct("id").alias("df")),
                       sql("SELECT field, token, count(*) AS n, count(DISTINCT id) AS df FROM t GROUP BY ALL", DOCUMENTS, TOKENS)),
    "term_stats": (lambda spark, folder: P.term_stats(P.build_postings(fixture.load_documents(spark, folder), fields=("content",))),
                   sql("SELECT token, count(DISTINCT id) AS df, count(*) AS cf, CASE WHEN count(DISTINCT id) >= 10 THEN 'common' "
                       "WHEN count(DISTINCT id) > 3 THEN 'specific' ELSE 'rare' END AS band FROM t WHERE field = 'content' "
                       "GROUP BY token", DOCUMENTS, TOKENS)),
    "postings_join": (_postings_join, sql("SELECT r.type, count(*) AS postings, count(DISTINCT t.id) AS n FROM t LEFT JOIN r ON t.id = r.id "
                                          "WHERE t.field = 'content' GROUP BY 1", DOCUMENTS, TOKENS)),
    "saved_queries": (_saved, sql(" UNION ALL ".join(f"SELECT '{n}' AS query_id, site, id FROM r WHERE {c}"
                                                     for n, (_, c) in SAVED.items()), DOCUMENTS)),
    "query_programs": (lambda spark, folder: fixture.document_index(spark, folder).search({name: query for name, (query, _) in MANY.items()}),
                       sql(" UNION ALL ".join(f"SELECT '{n}' AS query_id, site, id FROM r WHERE {c}" for n, (_, c) in MANY.items()), DOCUMENTS)),
    "index_vocabulary": (lambda spark, folder: fixture.document_index(spark, folder).view().terms(),
                         sql("SELECT field, token, count(DISTINCT id) AS df, count(*) AS cf FROM t GROUP BY ALL", DOCUMENTS, TOKENS)),
    "index_segments": _segments(False),
    "index_merged": _segments(True),
    "phrase_index": _one("phrase"),
    "prefix_index": _one("stem"),
}

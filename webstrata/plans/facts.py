"""Per-page facts: one pass over the HTML yields the narrow table that the audits read.

Every column is a native expression over ``content``, so an audit that selects only
the title evaluates only the title's pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as N
from ..functions import text as tx
from ..operators.groups import spread

# A tag or element left open runs to the end of the page, as in browsers.  That also keeps every
# pattern linear on pages that open thousands of elements and close none.
TAG_END = r"[^>]*(?:>|\z)"
NON_TEXT = (rf"(?is)<script\b{TAG_END}.*?(?:</script\s*>|\z)|<style\b{TAG_END}.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
            rf"|<[a-z/!?]{TAG_END}")
OPAQUE = rf"(?is)<!--.*?(?:-->|\z)|(<(?:script|style)\b{TAG_END}).*?(?:</(?:script|style)\s*>|\z)"
VALUE = r"(?is)\s(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
SRCSET = r"(?is)\ssrcset\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
BASE = rf"(?is)<base\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
REL = r"(?is)\srel\s*=\s*[\"']?([^\"'>]*)"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")]


def unescape(col: Column) -> Column:
    """The entities that HTML writers must use."""
    for name, char in ENTITIES:
        col = F.replace(col, F.lit(name), F.lit(char))
    return col


def visible_text(html: Column) -> Column:
    return tx.squash(F.regexp_replace(html, NON_TEXT, " "))


def without_scripts(html: Column) -> Column:
    """HTML with comments and the bodies of scripts and styles removed, their tags kept."""
    return F.regexp_replace(html, OPAQUE, "$1")


def tags(html: Column, *names: str) -> Column:
    """Start tags of some elements, whole, in page order: one pass, later tests read short strings."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{'|'.join(names)})\b{TAG_END}"), F.lit(0))


def any_tag(found: Column, pattern: str) -> Column:
    return F.exists(found, lambda t: t.rlike(pattern))


def count_tags(found: Column, pattern: str) -> Column:
    return F.size(F.filter(found, lambda t: t.rlike(pattern))).cast("long")


def title(html: Column) -> Column:
    value = unescape(tx.squash(F.regexp_extract(html, rf"(?is)<title\b{TAG_END}(.*?)(?:</title\s*>|\z)", 1)))
    return F.when(value != "", value)


def meta_description(found: Column) -> Column:
    tag = F.try_element_at(F.filter(found, lambda t: t.rlike(r"(?is)^<meta\b.*\sname\s*=\s*[\"']?description\b")), F.lit(1))
    double = F.regexp_extract(tag, r'(?is)\scontent\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, r"(?is)\scontent\s*=\s*'([^']*)'", 1)
    value = unescape(tx.squash(F.when(double != "", double).otherwise(single)))
    return F.when(value != "", value)


def headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])\b"), F.lit(1)),
                       lambda x: x.cast("int"))


def h1_texts(html: Column) -> Column:
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<h1\b{TAG_END}(.*?)(?:</h1\s*>|(?=<h[1-6]\b)|\z)"), F.lit(1))
    return F.transform(inner, lambda x: unescape(tx.squash(F.regexp_replace(x, "<[^>]*>", " "))))


def count_of(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern)).cast("long")


def page_facts(resources: DataFrame) -> DataFrame:
    """Narrow per-page table over the HTML rows of a resource table."""
    html, head, text = F.col("content"), F.col("tags"), F.col("text")
    pages = resources.where((F.col("type") == "html") & html.isNotNull()).select("site", "id", "url", "content")
    parts = spread(pages).select(
        "site", "id", "url", "content", visible_text(html).alias("text"),
        tags(html, "html", "link", "meta", "script", "img").alias("tags"))

    def og(name: str) -> Column:
        return any_tag(head, rf"(?is)^<meta\b.*\sproperty\s*=\s*[\"']?og:{name}\b")

    return parts.select(
        "site", "id", "url",
        title(html).alias("title"),
        meta_description(head).alias("description"),
        any_tag(head, r"(?is)^<link\b.*\srel\s*=\s*[\"']?canonical\b").alias("has_canonical"),
        og("title").alias("has_og_title"), og("description").alias("has_og_description"), og("image").alias("has_og_image"),
        any_tag(head, r"(?is)^<meta\b.*\sname\s*=\s*[\"']?viewport\b").alias("has_viewport"),
        any_tag(head, r"(?is)^<html\b.*\slang\s*=").alias("has_lang"),
        any_tag(head, r"(?is)^<script\b.*application/ld\+json").alias("has_json_ld"),
        headings(html).alias("levels"),
        h1_texts(html).alias("h1"),
        F.size(tx.tokens(text)).cast("long").alias("words"),
        F.sha2(F.lower(text), 256).alias("text_hash"),
        count_tags(head, r"(?i)^<img\b").alias("images"),
        count_tags(head, r"(?is)^<img\b.*\salt\s*=").alias("images_with_alt"))


def link_table(resources: DataFrame) -> DataFrame:
    """One row per reference in an HTML page, in page order; the candidates of a ``srcset`` follow at the place of their tag.

    References are resolved against the page's ``<base href>`` where it has one.
    """
    pages = resources.where((F.col("type") == "html") & F.col("content").isNotNull())
    markup = tags(without_scripts(F.col("content")), "a", "area", "link", "script", "img", "iframe", "source", "video",
                  "audio", "embed")
    markup = F.filter(markup, lambda t: t.rlike(VALUE) | t.rlike(SRCSET))
    against = N.resolve_url(F.col("url"), F.trim(unescape(F.concat(*[F.regexp_extract(without_scripts(F.col("content")), BASE, g) for g in (1, 2, 3)]))))
    has_base = F.lower("content").contains("<base")
    base = spread(pages.select("site", "id", "url", "content")).select(
        "site", "id", "url", F.when(has_base, against).otherwise(F.col("url")).alias("against"), F.posexplode(markup).alias("pos", "markup"))
    tag = F.lower(F.regexp_extract("markup", r"^<([A-Za-z]+)", 1))
    raw = F.trim(unescape(F.concat(*[F.regexp_extract("markup", VALUE, g) for g in (1, 2, 3)])))
    rel = F.lower(F.trim(F.regexp_extract("markup", REL, 1)))
    candidates = F.split(F.trim(unescape(F.concat(*[F.regexp_extract("markup", SRCSET, g) for g in (1, 2)]))), r"\s*,\s+|,(?=\S+://)")
    values = F.concat(F.array(raw), F.transform(candidates, lambda c: F.split_part(F.trim(c), F.lit(" "), F.lit(1))))
    split = base.select("site", "id", "url", "against", "pos", tag.alias("tag"), rel.alias("rel"), F.explode(values).alias("href_raw"))
    split = split.where(F.col("href_raw") != "")
    absolute = split.withColumn("href", N.resolve_url(F.col("against"), F.col("href_raw")))
    return absolute.select(
        "site", "id", "url", "pos", "tag", "rel", "href_raw", "href", N.host(F.col("href")).alias("host"),
        F.coalesce(N.host(F.col("href")) == N.host(F.col("url")), F.lit(False)).alias("internal"))

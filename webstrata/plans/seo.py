"""Audit of titles, descriptions, headings and text, over the page-facts table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.groups import with_group_size
from .errors import percent
from .facts import visible_text
from .files import url_template

ROW = ["site", "id"]


def length_verdict(col: Column, low: int, high: int) -> Column:
    n = F.length(col)
    return (F.when(col.isNull(), "missing").when(n < low, "short").when(n > high, "long")
            .otherwise("optimal"))


def title_audit(facts: DataFrame) -> DataFrame:
    """Title, its length verdict and how many pages share it."""
    pages = with_group_size(facts.select(*ROW, "url", "title"), ["title"], ROW, "pages_with_title")
    return pages.select("site", "id", "url", "title", F.length("title").alias("length"),
                        length_verdict(F.col("title"), 30, 60).alias("verdict"), "pages_with_title")


def title_summary(facts: DataFrame) -> DataFrame:
    """Verdict counts, with the number of pages whose title is not theirs alone."""
    counts = facts.groupBy("title").agg(F.count("*").alias("n"))
    return counts.groupBy(length_verdict(F.col("title"), 30, 60).alias("verdict")).agg(
        F.sum("n").alias("pages"),
        F.sum(F.when((F.col("n") > 1) & F.col("title").isNotNull(), F.col("n")).otherwise(0))
        .alias("duplicated"))


def meta_audit(facts: DataFrame) -> DataFrame:
    flags = ["has_canonical", "has_og_title", "has_og_description", "has_og_image", "has_viewport",
             "has_lang", "has_json_ld"]
    pages = with_group_size(facts.select(*ROW, "url", "description", *flags), ["description"], ROW,
                            "pages_with_description")
    return pages.select("site", "id", "url", F.length("description").alias("length"),
                        length_verdict(F.col("description"), 120, 158).alias("verdict"),
                        "pages_with_description", *flags)


def hierarchy_breaks(levels: Column) -> Column:
    """Number of headings that skip a level against the heading before them."""
    pairs = F.arrays_zip(F.slice(levels, 1, 1 << 30).alias("a"), F.slice(levels, 2, 1 << 30).alias("b"))
    return F.size(F.filter(pairs, lambda p: F.coalesce(p["b"] > p["a"] + 1, F.lit(False)))).cast("long")


def longest(texts: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(texts, lambda x: F.length(x))), F.lit(0))


def heading_audit(facts: DataFrame) -> DataFrame:
    h1 = F.size(F.filter("levels", lambda x: x == 1)).cast("long")
    return facts.select(
        "site", "id", "url", F.size("levels").cast("long").alias("headings"), h1.alias("h1_count"),
        F.when(h1 == 0, "missing").when(h1 > 1, "multiple").otherwise("single").alias("h1_verdict"),
        hierarchy_breaks(F.col("levels")).alias("breaks"),
        (longest(F.col("h1")) > 70).alias("h1_too_long"))


def content_quality(facts: DataFrame) -> DataFrame:
    """Words, images without alt text, and pages with the very same visible text."""
    slim = facts.select(*ROW, "url", "words", "images", "images_with_alt", "text_hash")
    pages = with_group_size(slim, ["text_hash"], ROW, "pages_with_text")
    return pages.select("site", "id", "url", "words", "images",
                        (F.col("images") - F.col("images_with_alt")).alias("images_without_alt"),
                        "pages_with_text")


def keyword_density(resources: DataFrame, keyword: str) -> DataFrame:
    """Share of one word among a page's words; 1-3 % is considered right."""
    words = tx.tokens(visible_text(F.col("content")))
    hits = F.size(F.filter("words", lambda w: w == keyword.lower())).cast("long")
    pages = resources.where((F.col("type") == "html") & F.col("content").isNotNull()).select(
        "site", "id", "url", words.alias("words"))
    counts = pages.select("site", "id", "url", hits.alias("hits"), F.size("words").cast("long").alias("words"))
    density = percent(F.col("hits"), F.col("words"))
    band = F.when(density < 1, "low").when(density <= 3, "right").when(density > 3, "stuffed")
    return counts.select("*", density.alias("density"), band.alias("band"))


def page_scorecard(facts: DataFrame) -> DataFrame:
    """Issue flags per page with the number of high, medium and low ones."""
    marked = with_group_size(
        facts.select(*ROW, "url", "title", "description", "levels", "h1", "images", "images_with_alt"),
        ["title"], ROW, "same_title")
    h1 = F.size(F.filter("levels", lambda x: x == 1))
    verdict = length_verdict(F.col("title"), 30, 60)
    issues = {
        "h1_not_single": h1 != 1,
        "title_duplicate": F.col("same_title") > 1,
        "description_missing": F.col("description").isNull(),
        "title_length": verdict != "optimal",
        "hierarchy_broken": hierarchy_breaks(F.col("levels")) > 0,
        "title_generic": F.coalesce(F.lower("title").isin("page title", "untitled"), F.lit(False)),
        "h1_too_long": longest(F.col("h1")) > 70,
        "alt_missing": F.col("images") > F.col("images_with_alt"),
        "no_h2": ~F.array_contains("levels", 2),
    }
    rank = {"high": list(issues)[:5], "medium": list(issues)[5:8], "low": list(issues)[8:]}
    flagged = marked.select("site", "id", "url", *[c.alias(n) for n, c in issues.items()])

    def count(names: list[str]) -> Column:
        return sum((F.col(n).cast("long") for n in names[1:]), F.col(names[0]).cast("long"))

    return flagged.select("*", *[count(names).alias(level) for level, names in rank.items()])


def issue_matrix(scorecard: DataFrame) -> DataFrame:
    """Issue counts by URL template."""
    issues = [n for n, t in scorecard.dtypes if t == "boolean"]
    return scorecard.groupBy(url_template(F.col("url")).alias("template")).agg(
        F.count("*").alias("pages"), *[F.count_if(F.col(n)).alias(n) for n in issues])

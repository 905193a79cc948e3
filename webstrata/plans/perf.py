"""Audit of what pages load and refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as N
from ..operators.groups import salted_join
from .facts import TAG_END, count_of, count_tags, tags

ASSET_TAGS = ["script", "img", "iframe", "source", "video", "audio", "embed"]

# name -> pattern counted in pages, style sheets and scripts
ANTI_PATTERNS = {
    "css import": r"(?i)@import\b",
    "important": r"(?i)!important\b",
    "getElementById": r"document\.getElementById\b",
    "jquery": r"(?i)\bjQuery\b|\$\(",
    "vendor prefix": r"(?i)-(webkit|moz|ms|o)-[a-z]",
}
LIMITS = {"css_bytes": 200 * 1024, "js_bytes": 500 * 1024, "asset_hosts": 3, "blockers": 3}


def broken_links(links: DataFrame, resources: DataFrame) -> DataFrame:
    """Internal targets that were not captured, or captured with an error.

    References are reduced to one row per target before they meet the resource table.
    """
    targets = (links.where("internal").groupBy("href", "site", "id", "url").agg(F.count("*").alias("refs"))
               .groupBy("href").agg(F.count("*").alias("pages"), F.sum("refs").alias("refs"),
                                    F.min("url").alias("example")))
    captured = (resources.where(F.col("status") >= 100)
                .groupBy(F.regexp_replace("url", "#.*$", "").alias("href")).agg(F.min("status").alias("status")))
    return (targets.join(captured, "href", "left")
            .where(F.col("status").isNull() | (F.col("status") >= 400))
            .select("href", "status", "pages", "refs", "example"))


def broken_link_referrers(links: DataFrame, broken: DataFrame) -> DataFrame:
    """Every (target, page) pair behind the broken links."""
    pairs = links.where("internal").select("href", "site", "id", "url").distinct()
    return salted_join(pairs, broken.select("href"), ["href"], ["site", "id"]).select("href", "url")


def shared_assets(links: DataFrame) -> DataFrame:
    """How many pages load an asset, and whether it is global or only the homepage's."""
    home = N.url_path(F.col("url")) == "/"
    loaded = F.col("tag").isin(ASSET_TAGS) | ((F.col("tag") == "link") & F.col("rel").rlike("stylesheet|icon|preload"))
    per_page = links.where(loaded).select("href", "site", "id", home.alias("home")).distinct()
    counts = per_page.groupBy("href").agg(F.count("*").alias("pages"), F.count_if("home").alias("home"))
    scope = (F.when(F.col("pages") > 1, "global").when(F.col("home") > 0, "homepage")
             .otherwise("single page"))
    return counts.select("href", "pages", scope.alias("scope"))


def shared_links(links: DataFrame) -> DataFrame:
    """The same count for ordinary links: how many pages point to a target."""
    return (links.where(F.col("tag") == "a").select("href", "site", "id").distinct()
            .groupBy("href").agg(F.count("*").alias("pages")))


def link_counts(links: DataFrame) -> DataFrame:
    """Internal and external links per page that has any."""
    return links.where(F.col("tag") == "a").groupBy("site", "id", "url").agg(
        F.count_if("internal").alias("internal_links"), F.count_if(~F.col("internal")).alias("external_links"))


def render_blockers(resources: DataFrame) -> DataFrame:
    """Per page: what delays its first paint."""
    html, found = F.col("content"), F.col("tags")
    external = r"(?is)^<script\b.*\ssrc\s*="
    scripts = count_tags(found, external)
    deferred = F.size(F.filter(found, lambda t: t.rlike(external) & t.rlike(r"(?is)\s(?:async|defer)\b"))).cast("long")
    inline_css, inline_js = F.col("css"), F.col("js")

    def weight(texts):
        return F.aggregate(texts, F.lit(0).cast("long"), lambda acc, x: acc + F.octet_length(x))

    def bodies(name: str):
        return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b{TAG_END}(.*?)(?:</{name}\s*>|\z)"), F.lit(1))

    pages = resources.where((F.col("type") == "html") & html.isNotNull()).select(
        "site", "id", "url", tags(html, "link", "script").alias("tags"), bodies("style").alias("css"), bodies("script").alias("js"))
    facts = pages.select(
        "site", "id", "url", count_tags(found, r"(?is)^<link\b.*\srel\s*=\s*[\"']?stylesheet\b").alias("stylesheets"),
        scripts.alias("scripts"), (scripts - deferred).alias("blocking_scripts"),
        F.size(inline_css).cast("long").alias("inline_styles"), weight(inline_css).alias("inline_css_bytes"),
        F.size(F.filter(inline_js, lambda x: F.trim(x) != "")).cast("long").alias("inline_scripts"),
        weight(inline_js).alias("inline_js_bytes"))
    return facts.withColumn("blockers", F.col("stylesheets") + F.col("blocking_scripts"))


def performance_totals(resources: DataFrame, blockers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals against their benchmarks, one row per metric: of all rows, or of each value of the columns ``by``, as ``site``."""
    sizes = resources.where(F.col("type").isin("style", "script")).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("type") == "style", F.col("size"))), F.lit(0)).alias("css_bytes"),
        F.coalesce(F.sum(F.when(F.col("type") == "script", F.col("size"))), F.lit(0)).alias("js_bytes"),
        F.countDistinct(N.host(F.col("url"))).alias("asset_hosts"))
    worst = blockers.groupBy(*by).agg(F.coalesce(F.max("blockers"), F.lit(0)).alias("blockers"))

    def long(df: DataFrame, names: list[str]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value"),
                                  F.lit(LIMITS[n]).cast("long").alias("benchmark")) for n in names])
        return df.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")

    table = long(sizes, ["css_bytes", "js_bytes", "asset_hosts"]).unionByName(long(worst, ["blockers"]))
    within = (F.when(F.col("metric") == "asset_hosts", F.col("value") <= F.col("benchmark"))
              .otherwise(F.col("value") < F.col("benchmark")))
    return table.withColumn("ok", within)


def anti_patterns(resources: DataFrame, patterns: dict[str, str] = ANTI_PATTERNS) -> DataFrame:
    """Occurrences and affected files of each pattern, by resource type."""
    html = F.col("content")
    rows = F.array(*[F.struct(F.lit(n).alias("pattern"), count_of(html, p).alias("hits"))
                     for n, p in patterns.items()])
    return (resources.where(F.col("type").isin("html", "style", "script") & html.isNotNull())
            .select("type", F.explode(rows).alias("r")).select("type", "r.*")
            .groupBy("pattern", "type")
            .agg(F.sum("hits").alias("occurrences"), F.count_if(F.col("hits") > 0).alias("files")))

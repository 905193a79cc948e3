"""Audit of the files of a site: what there is, how big, where it lives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as N
from ..operators.groups import cut
from .errors import host_relation, percent

# bytes above which an asset is reported, by type
OVERSIZED = {"img": 2 * 1024 * 1024, "script": 500 * 1024, "style": 200 * 1024}
LARGE = {"script": 100 * 1024, "style": 100 * 1024}
CDN_HOSTS = r"(^|\.)(cloudflare\.com|jsdelivr\.net|unpkg\.com|googleapis\.com|gstatic\.com|bootstrapcdn\.com)$"
ASSET_NAMES = r"(static|cdn|assets|media)"
ASSET_SUBDOMAINS = r"^(static|cdn|assets?|media|img|images|js|css|files|downloads)[0-9]*\."
ASSET_TYPES = ["img", "script", "style", "font", "audio", "video"]


def type_counts(resources: DataFrame) -> DataFrame:
    """Rows and bytes by site and type, with totals per site and overall (NULL)."""
    return resources.rollup("site", "type").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"))


def size_stats(resources: DataFrame) -> DataFrame:
    """Count, maximum, mean and exact quantiles of the sizes of each type.

    Ranks come from range partitions of the distinct sizes: running sums within a partition, and what the partitions
    before it hold.  No task sees all sizes of a type.
    """
    basic = resources.groupBy("type").agg(
        F.count("*").alias("n"), F.max("size").alias("largest"),
        F.round(F.avg("size"), 4).alias("average"),
    )
    sizes = resources.where(F.col("size").isNotNull()).groupBy("type", "size").agg(F.count("*").alias("k"))
    placed = cut(sizes.repartitionByRange("type", "size").withColumn("part", F.spark_partition_id()))
    held = placed.groupBy(F.col("type").alias("of"), F.col("part").alias("p")).agg(F.sum("k").alias("held"))  # a row per type and partition
    by_type = W.partitionBy("of")
    before = held.select("of", "p", (F.sum("held").over(by_type.orderBy("p")) - F.col("held")).alias("before"), F.sum("held").over(by_type).alias("known"))
    within = placed.withColumn("upto", F.sum("k").over(W.partitionBy("type", "part").orderBy("size")))
    reached = within.join(before, (F.col("part") == F.col("p")) & F.col("type").eqNullSafe(F.col("of"))).withColumn("upto", F.col("upto") + F.col("before"))
    ranks = reached.groupBy("of").agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("known") * F.lit(q)), F.col("size"))).alias(n)
                                          for n, q in (("median", 0.5), ("p90", 0.9))])
    return basic.join(ranks, F.col("type").eqNullSafe(F.col("of")), "left").select(
        "type", "n", "largest", "average", "median", "p90")


def crawl_report(resources: DataFrame, keyword: Column) -> DataFrame:
    """The report's totals, each as a row, from one pass."""
    type_ = F.col("type")
    sections = {"all": F.lit(True), "html": type_ == "html", "keyword": (type_ == "html") & keyword,
                "style": type_ == "style", "script": type_ == "script", "img": type_ == "img"}
    seen = resources.where(F.col("status") >= 100)
    marked = seen.select(F.explode(F.array_compact(F.array(
        *[F.when(test, F.lit(name)) for name, test in sections.items()]))).alias("section"))
    return marked.groupBy("section").agg(F.count("*").alias("total"))


def crawl_report_urls(resources: DataFrame, keyword: Column) -> DataFrame:
    """Every (section, URL) of the report in long form."""
    type_ = F.col("type")
    names = (F.when(type_.isin("html", "style", "script", "img"), type_))
    hit = F.when((type_ == "html") & keyword, F.lit("keyword"))
    return (resources.where(F.col("status") >= 100)
            .select(F.explode(F.array_compact(F.array(F.lit("all"), names, hit))).alias("section"), "url"))


def file_types(resources: DataFrame, domain: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and bytes by type, inside and outside the domain; ``by`` names further columns, as ``site``, to tell apart."""
    inside = F.lower("url").contains(domain.lower())
    return resources.groupBy(*by, "type").agg(
        F.count_if(inside).alias("internal"), F.count_if(~inside).alias("external"),
        F.count("*").alias("total"), F.sum("size").alias("bytes"))


def asset_class(host: Column, domain: str) -> Column:
    relation = host_relation(host, domain)
    return (F.when(relation == "main", "main")
            .when((relation == "subdomain") & F.lower(host).rlike(ASSET_SUBDOMAINS), "asset subdomain")
            .when(F.lower(host).rlike(CDN_HOSTS), "third-party cdn")
            .when(relation == "subdomain", "subdomain").otherwise("external"))


def asset_hosts(resources: DataFrame, domain: str) -> DataFrame:
    """Hosts that serve assets, their class and how likely each is the asset host (3 high - 0 none)."""
    by_host = (resources.where(F.col("type").isin(ASSET_TYPES))
               .groupBy(N.host(F.col("url")).alias("host"))
               .agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    kind = F.col("class")
    score = (F.when(kind == "main", 1).when(F.lower("host").rlike(ASSET_NAMES), 3)
             .when(kind.isin("asset subdomain", "subdomain", "third-party cdn"), 2).otherwise(0))
    return by_host.withColumn("class", asset_class(F.col("host"), domain)).withColumn("score", score)


def best_asset_host(resources: DataFrame, domain: str) -> DataFrame:
    return asset_hosts(resources, domain).agg(
        F.max_by("host", F.struct("score", "n", "host")).alias("host"), F.max("score").alias("score"))


def directories(resources: DataFrame, depth: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows by the first path segments, and by further columns."""
    parts = [F.coalesce(N.path_segment(F.col("url"), i), F.lit("")) for i in range(1, depth + 1)]
    return (resources.groupBy(*by, F.concat_ws("/", *parts).alias("directory"))
            .agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))


def url_template(url: Column) -> Column:
    """URL path with every run of digits replaced."""
    return F.regexp_replace(N.url_path(url), "[0-9]+", "{n}")


def url_templates(resources: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return (resources.groupBy(*by, url_template(F.col("url")).alias("template"))
            .agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))


def template_sample(resources: DataFrame, k: int = 3) -> DataFrame:
    """``k`` pages per URL template, first by URL, with the template's page count.

    Pages are counted by a plain aggregation.  The best are found in two steps, per salt and per template; the limit on
    each rank is applied before the shuffle, so a template that most pages share is never sorted in one task.
    """
    pages = (resources.where(F.col("type") == "html")
             .select("site", "id", "url", url_template(F.col("url")).alias("template"),
                     F.pmod(F.xxhash64("url"), F.lit(64)).alias("salt")))
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("url", "id", "site"))
    best = pages.withColumn("rank", rank("template", "salt")).where(F.col("rank") <= k).drop("rank")
    best = best.withColumn("rank", rank("template")).where(F.col("rank") <= k)
    counts = pages.groupBy("template").agg(F.count("*").alias("pages"))
    return best.join(counts, "template").select("template", "pages", F.col("rank").cast("long").alias("rank"), "site", "id", "url")


def format_mix(resources: DataFrame) -> DataFrame:
    """File-name extensions among images."""
    counts = (resources.where(F.col("type") == "img")
              .groupBy(N.extension(N.url_path(F.col("url"))).alias("extension"))
              .agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    # extensions are as many as sites make up: the total is a scalar, not a window over all of them in one task
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", percent(F.col("n"), total))


def _limit(limits: dict[str, int]) -> Column:
    return N.lookup(limits, F.col("type"))


def size_tier(oversized: dict[str, int], large: dict[str, int]) -> Column:
    return (F.when(F.col("size") > _limit(oversized), "oversized")
            .when(F.col("size") > _limit(large), "large").otherwise("ok"))


def oversized(resources: DataFrame, limits: dict[str, int] = OVERSIZED,
              large: dict[str, int] = LARGE) -> DataFrame:
    """Assets above the limit of their type."""
    return (resources.where(F.col("type").isin(list(limits)))
            .select("site", "id", "url", "type", "size", size_tier(limits, large).alias("tier"))
            .where(F.col("tier") != "ok"))


def size_tiers(resources: DataFrame, limits: dict[str, int] = OVERSIZED,
               large: dict[str, int] = LARGE) -> DataFrame:
    return (resources.where(F.col("type").isin(list(limits)))
            .groupBy("type", size_tier(limits, large).alias("tier"))
            .agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))


def freshness(resources: DataFrame, months: int = 6) -> DataFrame:
    """Share of pages modified in the last months before the newest page.

    Reduced to one row per day first; only that calendar is compared with its maximum.
    """
    days = (resources.where((F.col("type") == "html") & F.col("modified").isNotNull())
            .groupBy(F.to_date("modified").alias("day")).agg(F.count("*").alias("n")))
    newest = F.max("day").over(W.partitionBy())
    marked = days.withColumn("fresh", F.col("day") >= F.add_months(newest, -months))
    counts = marked.agg(F.sum("n").alias("pages"), F.max("day").cast("string").alias("newest"),
                        F.sum(F.when(F.col("fresh"), F.col("n")).otherwise(0)).alias("fresh"))
    return counts.withColumn("share", percent(F.col("fresh"), F.col("pages")))


def orphan_assets(resources: DataFrame, links: DataFrame) -> DataFrame:
    """Captured non-page resources that no page refers to."""
    assets = (resources.where((F.col("type") != "html") & (F.col("status") >= 100))
              .select("site", "id", "url", "type", "size", F.regexp_replace("url", "#.*$", "").alias("href")))
    return assets.join(links.select("href").distinct(), "href", "left_anti").select("site", "id", "url", "type", "size")


def image_urls(resources: DataFrame) -> DataFrame:
    """Distinct image URLs without query; other schemes only with an image extension."""
    url = F.col("url")
    web = F.lower(url).rlike("^https?://[^/?#]")
    clean = (F.when(web, F.regexp_replace(url, "[?#].*$", ""))
             .when(url.rlike(r"(?i)\.(jpg|jpeg|png|gif|bmp|webp)$"), F.regexp_replace(url, r"\?.*$", "")))
    return (resources.where(F.col("type") == "img").select(clean.alias("url"))
            .where(F.col("url").isNotNull()).distinct())

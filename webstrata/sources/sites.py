"""Listings of the sites that a crawl folder holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as N
from ..schema import SITE
from .common import visible_site
from .files import _LISTED, _expand, _tasks, list_level, name_of, with_body
from .warc import warc_files


def _conform(df: DataFrame, ids: list[int] | None) -> DataFrame:
    sites = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SITE])
    return sites if ids is None else sites.where(F.col("id").isin(ids))


def _folders(spark: SparkSession, root: str) -> DataFrame:
    return list_level(spark, root).where("folder").where(visible_site(F.col("rel")))


def _inside(folders: DataFrame) -> DataFrame:
    """Direct children of the folders."""
    return folders.repartition(_tasks(folders.sparkSession), "path").mapInArrow(_expand(False), _LISTED)


def robots_text(text: Column) -> Column:
    """Body of a robots file, which may be stored with its URL and request before it."""
    parts = F.split(text, "\n\n", 3)
    response = F.split(F.get(parts, 2), "\n\n", 2)
    return F.when(F.size(parts) == 3, F.coalesce(F.try_element_at(response, F.lit(2)), F.get(response, 0))).otherwise(text)


def list_sites(spark: SparkSession, root: str, ids: list[int] | None = None) -> DataFrame:
    """One site per folder, with its robots file if it has one."""
    folders = _folders(spark, root)
    site = F.split_part("rel", F.lit("/"), F.lit(1))
    found = _inside(folders).where(~F.col("folder") & name_of(F.col("rel")).contains("robots.txt")).withColumn("site", site)
    first = found.groupBy("site").agg(F.min_by(F.struct("path", "length"), "path").alias("f")).select("site", "f.*")
    robots = with_body(first).select("site", robots_text(N.decode_text(F.col("body"))).alias("robots"))
    name = F.col("rel")
    return _conform(folders.join(robots, folders.rel == robots.site, "left").select(
        N.resource_id(name).alias("id"), name.alias("name"), F.lit("url").alias("type"),
        F.array(F.concat(F.lit("https://"), name, F.lit("/"))).alias("urls"), "path",
        F.col("modified").alias("created"), "modified", "robots"), ids)


def list_archivebox_sites(spark: SparkSession, root: str, ids: list[int] | None = None) -> DataFrame:
    """Folders that hold an ``archive`` folder."""
    folders = _folders(spark, root)
    held = _inside(folders).where(F.col("folder") & (name_of(F.col("rel")) == "archive"))
    held = held.select(F.split_part("rel", F.lit("/"), F.lit(1)).alias("site"))
    name = F.col("rel")
    return _conform(folders.join(held, folders.rel == held.site, "left_semi").select(
        N.resource_id(name).alias("id"), name.alias("name"), F.lit("list").alias("type"),
        F.array(F.concat(F.lit("archivebox://"), name, F.lit("/"))).alias("urls"), "path",
        F.col("modified").alias("created"), "modified", F.lit(None).cast("string").alias("robots")), ids)


def list_warc_sites(spark: SparkSession, root: str, ids: list[int] | None = None) -> DataFrame:
    """One site per WARC file."""
    return _conform(warc_files(spark, root).select(
        N.resource_id(F.col("name")).alias("id"), "name", F.lit("url").alias("type"), F.array("path").alias("urls"),
        "path", F.col("modified").alias("created"), "modified", F.lit(None).cast("string").alias("robots")), ids)


def sites_from_projects(projects: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Sites from exported project rows (id, name, type code, newline-separated urls, created, modified)."""
    urls = F.filter(F.transform(F.split(F.coalesce("urls", F.lit("")), "\n"), lambda u: F.trim(u)),
                    lambda u: u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))
    kind = F.when(F.col("type") == 1, "url").when(F.col("type") == 2, "list").otherwise("undefined")
    return _conform(projects.select(
        "id", "name", kind.alias("type"), urls.alias("urls"), F.lit(None).cast("string").alias("path"),
        N.parse_zulu(F.col("created").cast("string")).alias("created"),
        N.parse_zulu(F.col("modified").cast("string")).alias("modified"), F.lit(None).cast("string").alias("robots")), ids)

"""Page archives: numbered entries, each with metadata, the page and its assets by domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as N
from ..operators.groups import cut, latest_by
from .common import to_resources, visible_site
from .files import below, list_files, name_of, with_body

INDEX = "struct<url:string,canonical:struct<dom_path:string,wget_path:string>>"


def entry_files(spark: SparkSession, root: str) -> DataFrame:
    """Files inside entries: site, entry and the path below the entry."""
    parts = F.split("rel", "/")
    files = list_files(spark, root).where((F.size(parts) >= 4) & (F.get(parts, 1) == "archive") & F.get(parts, 2).rlike(r"^[0-9.]*[0-9][0-9.]*$"))
    return files.select("*", F.get(parts, 0).alias("site"), F.get(parts, 2).alias("entry"), below(F.col("rel"), 3).alias("inner")
                        ).where(visible_site(F.col("site")))


def entries(files: DataFrame) -> DataFrame:
    """One row per entry with what its metadata says; unreadable metadata counts as absent."""
    own = files.where(F.col("inner").isin("index.json", "headers.json", "index.html"))
    text = N.decode_text(F.col("body"))
    read = with_body(own, F.col("inner").endswith(".json"))
    index = F.from_json(F.max(F.when(F.col("inner") == "index.json", text)), INDEX)
    headers = F.from_json(F.max(F.when(F.col("inner") == "headers.json", text)), "map<string,string>")
    return read.groupBy("site", "entry").agg(
        index.alias("index"), headers.alias("http"), F.max("modified").alias("modified"))


def pages(files: DataFrame, found: DataFrame) -> DataFrame:
    """The captured page of each entry: its DOM dump, else the mirrored page, else the index page."""
    url = F.coalesce("index.url", F.concat(F.lit("archivebox://unknown/"), "entry"))
    code = F.split_part(F.try_element_at("http", F.lit("status")), F.lit(" "), F.lit(1)).try_cast("int")
    described = found.select(
        "site", "entry", "modified", url.alias("url"), F.coalesce(code, F.lit(200)).alias("status"),
        N.headers_text(F.col("http")).alias("headers"),
        F.array("index.canonical.dom_path", "index.canonical.wget_path", F.lit("index.html")).alias("choices"))
    choices = described.select("site", "entry", F.posexplode("choices").alias("rank", "inner")).where(F.col("inner").isNotNull())
    best = (choices.join(files.select("site", "entry", "inner", "path", "length"), ["site", "entry", "inner"])
            .groupBy("site", "entry").agg(F.min_by(F.struct("path", "length"), "rank").alias("file")))
    return described.join(best, ["site", "entry"], "left").select(
        "site", "url", "modified", "status", "headers", F.lit("html").alias("type"), F.lit(0).alias("kind"), "entry",
        F.coalesce("file.path", F.lit("")).alias("path"), F.coalesce("file.length", F.lit(0)).alias("length"))


def assets(files: DataFrame) -> DataFrame:
    """Files in the per-domain folders of an entry, with URL arguments cut from their names."""
    domain = F.split_part("inner", F.lit("/"), F.lit(1))
    name = name_of(F.col("inner"))
    folder = F.regexp_extract("inner", "^(.*/)", 1)
    clean = F.concat(folder, N.clean_asset_url(name))
    wanted = files.where(F.col("inner").contains("/") & ~domain.isin(S.ARCHIVE_SKIPPED_DIRECTORIES) & ~name.endswith("orig"))
    return wanted.select(
        "site", N.clean_asset_url(N.collapse_index_end(F.concat(F.lit("https://"), clean))).alias("url"), "modified",
        F.lit(200).alias("status"), F.lit(None).cast("string").alias("headers"),
        N.type_from_extension(N.extension(N.clean_asset_url(name))).alias("type"), F.lit(1).alias("kind"), "entry", "path", "length")


def read_archivebox(spark: SparkSession, root: str, content: bool = True, partitions: int | None = None) -> DataFrame:
    files = cut(entry_files(spark, root))
    found = cut(entries(files))
    known = files.join(found.select("site", "entry"), ["site", "entry"], "left_semi")
    rows = pages(files, found).unionByName(assets(known))
    # newest capture of a URL; of equal ones the page before the asset, the earlier entry before the later
    order = [F.col("modified"), -F.col("kind"), -F.col("entry").try_cast("decimal(30,10)"), F.col("path")]
    unique = latest_by(rows, ["site", "url"], order).withColumn("time", F.lit(0))
    return to_resources(unique, content, partitions)

"""Mirrored trees with a request log beside each site folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as N
from ..operators.groups import cut, latest_by
from .common import to_resources
from .files import name_of
from .httrack import read_log_lines
from .table import conform
from .wget import mirrored_files

LOG_END = "Redirected URLs"
STUB = '<meta http-equiv="refresh" content="0'


def milliseconds(value: Column) -> Column:
    """``120 ms``, ``1.2 s`` or a bare number of milliseconds."""
    number = F.regexp_extract(value, r"^([0-9.]+)", 1).try_cast("double")
    return (number * F.when(value.rlike(r"^[0-9.]+\s*s"), 1000).otherwise(1)).cast("int")


def byte_size(value: Column) -> Column:
    """``15 kB`` and the like; empty means zero."""
    number = F.regexp_extract(value, r"^([0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(value, r"^[0-9.]+\s+(\S+)", 1))
    factor = F.coalesce(N.lookup(S.BYTE_UNITS, unit), F.lit(1))
    return F.when(value == "", F.lit(0).cast("long")).otherwise((number * factor).cast("long"))


def parse_log(lines: DataFrame) -> DataFrame:
    """(file, url path, status, type, time, size) from (file, at, value) lines up to the end mark."""
    ends = lines.where(F.trim("value") == LOG_END).groupBy("file").agg(F.min("at").alias("end"))
    body = lines.join(ends, "file", "left").where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    parts = F.transform(F.split("value", r"\|", -1), lambda p: F.trim(p))
    rows = body.where(F.size(parts) == 10).select("file", "at", parts.alias("p"))

    def part(i: int) -> Column:
        return F.get("p", i)

    parsed = rows.select(
        "file", "at", F.regexp_extract(part(3), r"^([^?]*)", 1).alias("path"), part(4).try_cast("int").alias("status"),
        F.lower(part(5)).alias("type"), milliseconds(part(6)).alias("time"), byte_size(part(7)).alias("size"))
    # a row with a field that does not parse is a table head or damaged
    return parsed.where(F.col("status").isNotNull() & F.col("time").isNotNull() & F.col("size").isNotNull())


def site_log(spark: SparkSession, root: str, sites: DataFrame) -> DataFrame:
    """Log entries of the newest log of each site, the last entry of a URL winning."""
    lines = read_log_lines(spark, f"{root.rstrip('/')}/output.*.txt")
    stem = F.regexp_extract(name_of(F.col("file")), r"^output\.(.*)\.txt$", 1)
    parts = F.split(stem, r"\.")
    # the log's name starts with the site's: try every shorter dotted prefix of it
    names = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    logs = (lines.groupBy("file").agg(F.max("stamp").alias("stamp"))
            .withColumn("site", F.explode(F.when(F.size(parts) > 1, names))).join(sites, "site", "left_semi"))
    newest = latest_by(logs, ["site"], [F.col("stamp"), F.col("file")])
    entries = parse_log(lines).join(newest.select("site", "file"), "file")
    entries = entries.withColumn("url", F.concat(F.lit("https://"), "site", "path"))
    failed = F.col("status").between(400, 599)
    return latest_by(entries.select("site", "url", failed.alias("failed"), "status", "type", "time", "size", "at"),
                     ["site", "url", "failed"], [F.col("at")]).drop("at")


def aliases(url: Column) -> Column:
    """URLs under which the log may know a file, most exact first."""
    return F.array_distinct(F.array(
        url, F.regexp_replace(url, r"\.[0-9a-f]{8,}\.", "."), F.replace(url, F.lit(".html"), F.lit("")),
        F.replace(url, F.lit(".html"), F.lit("/")), F.replace(url, F.lit("index.html"), F.lit(""))))


def read_siteone(spark: SparkSession, root: str, content: bool = True, partitions: int | None = None) -> DataFrame:
    name = name_of(F.col("rel"))
    files = mirrored_files(spark, root).where(
        (name != "robots.txt") & ~(name.startswith("output.") & name.endswith(".txt")))
    # list and log serve several joins each: read them once
    files = cut(files.withColumn("url", N.path_to_url(F.col("site"), F.col("inner"))))
    log = cut(site_log(spark, root, files.select("site").distinct()))

    known = log.where(~F.col("failed")).select("site", F.col("url").alias("alias"),
                                               F.struct(F.col("url").alias("url"), "status", "type", "time").alias("entry"))
    tried = files.select("path", "rel", "length", "modified", "site", "url",
                         F.posexplode(aliases(F.col("url"))).alias("rank", "alias"))
    matched = (tried.join(known, ["site", "alias"], "left")
               .groupBy("path").agg(F.first(F.struct("rel", "length", "modified", "site", "url")).alias("f"),
                                    F.min_by("entry", F.when(F.col("entry").isNotNull(), F.col("rank"))).alias("entry"))
               .select("path", "f.*", "entry"))
    ext = N.extension(N.decruft_path(F.col("rel")))
    typed = cut(matched.select(
        "path", "rel", "length", "modified", "site", F.coalesce("entry.url", "url").alias("url"),
        F.when(F.col("entry.type") != "", N.type_from_log(F.col("entry.type"), ext)).otherwise(
            N.type_from_extension(ext)).alias("type"),
        F.coalesce("entry.status", F.lit(200)).alias("status"), F.coalesce("entry.time", F.lit(0)).alias("time")))

    # files that share a URL are told apart by content (a redirect stub loses); the others need no second look
    shared = typed.groupBy("site", "url").agg(F.count("*").alias("n"))
    counted = typed.join(shared, ["site", "url"])
    read = to_resources(counted.where("n = 1").drop("n"), content, partitions)
    again = to_resources(counted.where("n > 1").drop("n"), content, partitions)

    def real(df: DataFrame) -> DataFrame:
        return df.where(~F.coalesce((F.col("status") == 200) & F.col("content").contains(STUB), F.lit(False)))

    kept = real(read).unionByName(latest_by(real(again), ["site", "url"], [F.col("modified"), F.col("size")]))
    lost = (log.where("failed").join(typed.select("site", "url"), ["site", "url"], "left_anti"))
    errors = lost.select(
        N.resource_id(F.col("site")).alias("site"), N.resource_id(F.col("url")).alias("id"), "url",
        F.lit("other").alias("type"), "status", "size", "time",
        N.basic_headers(F.col("size"), F.lit("other"), F.lit("")).alias("headers"), F.lit("").alias("content"),
        F.lit(None).cast("timestamp").alias("created"), F.lit(None).cast("timestamp").alias("modified"))
    return kept.unionByName(conform(errors))

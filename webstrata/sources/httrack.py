"""Project folders with one folder per domain and a project log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as N
from ..operators.groups import cut
from .common import one_per_url, to_resources, visible_site
from .files import below, list_files

# --- fixed values: log lines and file suffixes
LAUNCH = r"launched on .+ at (https?://[^\s]+)"
REDIRECT = r"File has moved from (https?://[^\s]+) to .+"
ERROR = r'"[^"]+" \((\d+)\) at link (https?://[^\s]+)'
WEB_SUFFIXES = [".html", ".htm", ".css", ".js", ".png", ".jpg", ".gif"]
# --- end of fixed values


def is_host(name: Column) -> Column:
    """Labels between dots: 1 to 63 letters, digits and hyphens each, no hyphen at either end."""
    def label(x: Column) -> Column:
        return F.length(x).between(1, 63) & ~x.startswith("-") & ~x.endswith("-") & ~x.rlike("[^A-Za-z0-9-]")

    return F.forall(F.split(name, "[.]", -1), label)


def parse_log(lines: DataFrame) -> DataFrame:
    """(project, kind, url, status) from (project, at, value) log lines; the last entry of a URL wins."""
    value = F.col("value")
    entries = F.array_compact(F.array(
        F.when(value.rlike(ERROR), F.struct(F.lit("error").alias("kind"), F.regexp_extract(value, ERROR, 2).alias("url"),
                                            F.regexp_extract(value, ERROR, 1).cast("int").alias("status"))),
        F.when(value.rlike(REDIRECT), F.struct(F.lit("redirect").alias("kind"), F.regexp_extract(value, REDIRECT, 1).alias("url"),
                                               F.lit(302).alias("status"))),
        F.when(value.rlike(LAUNCH), F.struct(F.lit("launch").alias("kind"), F.regexp_extract(value, LAUNCH, 1).alias("url"),
                                             F.lit(None).cast("int").alias("status")))))
    rows = lines.select("project", "at", F.explode(entries).alias("e")).select("project", "at", "e.*")
    return rows.groupBy("project", "kind", "url").agg(F.max_by("status", "at").alias("status"), F.min("at").alias("at"))


def read_log_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(file, stamp, at, value): lines of text logs, ordered inside a file by ``at``.

    Large logs are split; block start and row order within the task restore the sequence.
    """
    try:
        lines = spark.read.text(glob)
    except AnalysisException:  # no log was left behind
        return spark.createDataFrame([], "file string, stamp timestamp, at struct<block:bigint,n:bigint>, value string")
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return lines.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"),
                        F.col("_metadata.file_modification_time").alias("stamp"), order.alias("at"), "value")


def read_httrack(spark: SparkSession, root: str, content: bool = True, partitions: int | None = None) -> DataFrame:
    lines = read_log_lines(spark, f"{root.rstrip('/')}/*/hts-log.txt")
    log = parse_log(lines.select(F.element_at(F.split("file", "/"), -2).alias("project"), "at", F.trim("value").alias("value")))

    # the list serves several joins: walk the tree once
    project, domain = F.split_part("rel", F.lit("/"), F.lit(1)), F.split_part("rel", F.lit("/"), F.lit(2))
    files = cut(list_files(spark, root).where(F.size(F.split("rel", "/")) >= 3)
             .withColumns({"site": project, "domain": domain, "inner": below(F.col("rel"), 2)})
             .where(visible_site(F.col("site")) & ~F.col("domain").startswith(".") & ~F.col("domain").startswith("hts-")))

    # base URL per domain folder: a handful of rows per project
    launch = (log.where(F.col("kind") == "launch").groupBy("project")
              .agg(F.min_by("url", "at").alias("launch")).withColumnRenamed("project", "site"))
    domains = (files.groupBy("site", "domain")
               .agg(F.bool_or(N.extension(F.col("rel")).isin(WEB_SUFFIXES)).alias("web")).where("web"))
    launched = N.host(F.col("launch"))
    same = F.replace(launched, F.lit("www."), F.lit("")) == F.replace("domain", F.lit("www."), F.lit(""))
    base = (F.when(F.coalesce(same, F.lit(False)), F.concat(N.scheme(F.col("launch")), F.lit("://"), launched, F.lit("/")))
            .when(is_host(F.col("domain")), F.concat(F.lit("https://"), "domain", F.lit("/")))
            .otherwise(F.concat(F.lit("https://"), "site", F.lit(".local/"), "domain", F.lit("/"))))
    bases = domains.join(launch, "site", "left").select("site", "domain", base.alias("base"))

    located = files.join(bases, ["site", "domain"]).withColumn("url", N.collapse_index(F.concat("base", "inner")))
    unique = one_per_url(located.select("path", "rel", "length", "modified", "site", "url"))
    state = (log.where(F.col("kind") != "launch").groupBy(F.col("project").alias("site"), "url")
             .agg(F.max(F.when(F.col("kind") == "error", F.col("status"))).alias("error"),
                  F.max(F.when(F.col("kind") == "redirect", F.col("status"))).alias("redirect")))
    typed = unique.join(state, ["site", "url"], "left").select(
        *unique.columns, N.type_from_extension(N.extension(F.col("rel"))).alias("type"),
        F.coalesce("error", "redirect", F.lit(200)).alias("status"), F.lit(0).alias("time"))
    return to_resources(typed, content, partitions)

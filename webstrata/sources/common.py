"""Steps that the file-tree readers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as N
from ..operators.groups import latest_by
from .files import with_body
from .table import conform


def visible_site(site: Column) -> Column:
    return ~site.startswith(".") & ~site.isin(S.IGNORED_DIRECTORIES)


def one_per_url(files: DataFrame) -> DataFrame:
    """The newest file of each URL; decided on the file list, before any content is read."""
    return latest_by(files, ["site", "url"], [F.col("modified"), F.col("path")])


def to_resources(files: DataFrame, content: bool = True, partitions: int | None = None) -> DataFrame:
    """Resource rows from files with site name, url, type, status and time.

    Headers and content follow from the file; an existing ``headers`` column is kept.
    """
    wanted = N.wants_content(F.col("path"), F.col("type"))
    read = (with_body(files, wanted, partitions) if content
            else files.withColumn("body", F.lit(None).cast("binary")))
    headers = N.basic_headers(F.col("length"), F.col("type"), F.col("path"))
    if "headers" in files.columns:
        headers = F.coalesce(F.col("headers"), headers)
    return conform(read.select(
        N.resource_id(F.col("site")).alias("site"), N.resource_id(F.col("url")).alias("id"), "url", "type", "status",
        F.col("length").alias("size"), "time", headers.alias("headers"),
        N.decode_text(F.col("body")).alias("content"),
        F.col("modified").alias("created"), F.col("modified").alias("modified")))

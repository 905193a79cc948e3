"""Mirrored directory trees: one folder per site, files as they were served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as N
from .common import one_per_url, to_resources, visible_site
from .files import below, list_files, name_of


def mirrored_files(spark: SparkSession, root: str) -> DataFrame:
    """Files inside site folders with the site's name and the path below it."""
    files = list_files(spark, root).where(F.col("rel").contains("/"))
    return files.withColumns({"site": F.split_part("rel", F.lit("/"), F.lit(1)), "inner": below(F.col("rel"), 1)}
                             ).where(visible_site(F.col("site")))


def read_wget(spark: SparkSession, root: str, content: bool = True, partitions: int | None = None) -> DataFrame:
    folder = F.regexp_extract("inner", "^(.*)/", 1)
    ignored = F.lit(False)
    for name in S.IGNORED_DIRECTORIES:
        ignored = ignored | folder.contains(name)
    files = mirrored_files(spark, root).where((name_of(F.col("rel")) != "robots.txt") & ~ignored)
    files = files.withColumns({
        "url": N.collapse_index(N.path_to_url(F.col("site"), F.col("inner"))),
        "type": N.type_from_extension(N.extension(N.decruft_path(F.col("rel")))),
        "status": F.lit(200), "time": F.lit(0)})
    return to_resources(one_per_url(files), content, partitions)

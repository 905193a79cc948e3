"""The stored resource table."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as N
from ..operators.groups import latest_by, work_folder
from ..schema import RESOURCE


def conform(df: DataFrame) -> DataFrame:
    """The resource columns in order and type."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESOURCE])


def observed(resources: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The same rows, counted while they pass; read the counts after the write."""
    seen = Observation(name)
    counted = resources.observe(
        seen, F.count(F.lit(1)).alias("processed"), F.count_if(F.col("content").isNull()).alias("without_content"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return counted, seen


def write_resources(resources: DataFrame, path: str, site_buckets: int | None = None) -> None:
    """Store partitioned by site, or by a fixed number of site buckets where sites are many.

    The rebalance hint lets Spark join small partitions and split large ones, so a
    site that makes up a third of the archive is written by many tasks.
    """
    if site_buckets is None:
        resources.hint("rebalance", "site").sortWithinPartitions("site", "url").write.mode("overwrite") \
            .partitionBy("site").parquet(path)
        return
    bucketed = resources.withColumn("site_bucket", F.pmod("site", F.lit(site_buckets)).cast("int"))
    _bucketed(bucketed).mode("overwrite").partitionBy("site_bucket").parquet(path)


def merge_resources(spark: SparkSession, path: str, captures: DataFrame, site_buckets: int) -> None:
    """Bring captures into a stored table of ``site_buckets``: of each (site, id) the newest stays, of equal times the one that comes now.

    Only the buckets that the captures fall into are read and written.  They are first made whole in the work folder; then
    Spark's dynamic overwrite replaces each bucket.  Parquet Bloom filters on id and url let lookups skip row groups.
    """
    bucket = F.pmod("site", F.lit(site_buckets)).cast("int")
    new = conform(captures).withColumn("site_bucket", bucket).withColumn("_now", F.lit(1))
    touched = [r[0] for r in new.select("site_bucket").distinct().collect()]  # numbers of buckets
    try:
        stored = spark.read.parquet(path)
        old = stored.where(F.col("site_bucket").isin(touched)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESOURCE], "site_bucket", F.lit(0).alias("_now"))
        both = old.unionByName(new)
    except AnalysisException:  # nothing is stored yet
        both = new
    stamp = lambda c: F.coalesce(c, F.lit(0).cast("timestamp"))
    newest = latest_by(both, ["site", "id"], [stamp(F.coalesce("modified", "created")), F.col("_now"), F.xxhash64("url", "content", "headers")])
    staged = f"{work_folder(spark)}/webstrata/merge-{uuid.uuid4().hex}"
    newest.drop("_now").write.parquet(staged)
    _bucketed(spark.read.schema(newest.drop("_now").schema).parquet(staged)).option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("site_bucket").parquet(path)


def _bucketed(rows: DataFrame):
    """A writer of rows by bucket, sorted by site and URL, with Bloom filters on what is looked up."""
    writer = rows.hint("rebalance", "site_bucket").sortWithinPartitions("site_bucket", "site", "url").write
    for column in ("id", "url"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", "100000")
    return writer


def load_resources(spark: SparkSession, path: str, sites: list[int] | None = None,
                   site_buckets: int | None = None) -> DataFrame:
    """The stored table; sites (and the bucket count it was written with) prune partitions."""
    df = spark.read.parquet(path)
    if sites is not None:
        if site_buckets is not None:
            df = df.where(F.col("site_bucket").isin(sorted({s % site_buckets for s in sites})))
        df = df.where(F.col("site").isin(sites))
    return conform(df)


def decode_type_codes(df: DataFrame, column: str = "type") -> DataFrame:
    """Replace the integer type codes of database exports by type names."""
    return df.withColumn(column, F.coalesce(N.decode_type(F.col(column)), F.lit("")))

"""Resource tables derived from plain page and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as N
from ..operators.groups import work_folder
from ..operators.index import Index


def resources_from_pages(pages: DataFrame, typed: bool = True) -> DataFrame:
    """(page_id, url, html) as a resource table; the missing columns follow from ``page_id``.

    ``typed`` tables hold invented types, for searches and audits by type, size and state.  Otherwise every row is the
    HTML page that it is, for everything that reads pages.
    """
    nth = F.col("page_id") % 20
    type_ = (F.when(F.col("page_id") % 10 == 0, "img").when(F.col("page_id") % 10 == 1, "script")
             .when(F.col("page_id") % 10 == 2, "style").otherwise("html")) if typed else F.lit("html")
    status = (F.when(nth == 3, 404).when(nth == 4, 301).when(nth == 5, 500).when(nth == 6, 0)
              .otherwise(200))
    stamp = F.timestamp_micros(F.lit(1704067200_000000) + F.col("page_id") * 3600_000000)
    size = F.octet_length("html").cast("long")
    return pages.select(
        N.resource_id(N.host(F.col("url"))).alias("site"),
        N.resource_id(F.col("url")).alias("id"),
        "url",
        type_.alias("type"),
        status.alias("status"),
        size.alias("size"),
        (F.col("page_id") % 500).cast("int").alias("time"),
        N.basic_headers(size, type_, N.url_path(F.col("url"))).alias("headers"),
        F.col("html").alias("content"),
        stamp.alias("created"),
        stamp.alias("modified"))


def resources_from_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) as a resource table with language as type and source as site."""
    stamp = F.timestamp_micros(F.lit(1704067200_000000) + F.col("doc_id") * 3600_000000)
    return documents.select(
        N.resource_id(F.col("source")).alias("site"),
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang").alias("type"),
        F.lit(200).alias("status"),
        F.col("n_chars").alias("size"),
        F.lit(0).alias("time"),
        F.lit(None).cast("string").alias("headers"),
        F.col("text").alias("content"),
        stamp.alias("created"),
        stamp.alias("modified"))


def load_pages(spark: SparkSession, folder: str) -> DataFrame:
    return resources_from_pages(spark.read.parquet(f"{folder}/pages.parquet"))


def load_html(spark: SparkSession, folder: str) -> DataFrame:
    return resources_from_pages(spark.read.parquet(f"{folder}/pages.parquet"), typed=False)


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    return resources_from_documents(spark.read.parquet(f"{folder}/documents.parquet"))


def document_index(spark: SparkSession, folder: str) -> Index:
    """The stored index of the documents, in the work folder; made when the table is first met, or met anew after a change."""
    files = spark.read.parquet(f"{folder}/documents.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    mark = files.distinct().agg(F.coalesce(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()[0]
    index = Index(spark, f"{work_folder(spark)}/webstrata/index{mark}")
    return index if index.committed()[1] else index.append(load_documents(spark, folder))

"""Text captures: one file per response with URL, request and response."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as N
from .files import list_files, name_of, with_body
from .common import visible_site
from .table import conform

# the head of a chunked response, up to its body
_CHUNKED = re.compile(rb"(?im)^HTTP/[^\n]*\n(?:[^\r\n][^\n]*\n)*?transfer-encoding:[ \t]*[^\n]*chunked[^\n]*\n(?:[^\r\n][^\n]*\n)*\r?\n")
_SIZE = re.compile(rb"\s*([0-9a-fA-F]+)[ \t]*(?:;[^\n]*)?\r?\n")
_LINE_END = re.compile(rb"(?:\r?\n)?")


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def unchunked(captures: Column) -> Column:
    """Captures whose chunked response bodies are put together again: sizes count bytes, so before any decoding."""
    @F.arrow_udf("binary")
    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([None if b is None else _whole(b) for b in bodies.to_pylist()], pa.binary())

    return run(captures)


def _whole(capture: bytes) -> bytes:
    head = _CHUNKED.search(capture)
    if not head:
        return capture
    parts, at = [capture[:head.end()]], head.end()
    while line := _SIZE.match(capture, at):
        size = int(line[1], 16)
        if not size:
            return b"".join(parts)
        parts.append(capture[line.end():line.end() + size])
        at = line.end() + size
        at += len(_LINE_END.match(capture, at)[0])
    return b"".join([*parts, capture[at:]])  # what follows is no chunk: kept as it is


def split_http_text(text: Column) -> dict[str, Column]:
    """URL, head and body of one capture; all NULL if a part is missing."""
    parts = F.split(text, "\n\n", 3)
    whole = F.size(parts) == 3
    response = F.split(strip(F.get(parts, 2)), "\n\n", 2)
    head = strip(F.get(response, 0))
    body = strip(F.coalesce(F.try_element_at(response, F.lit(2)), F.lit("")))
    return {"url": F.when(whole, strip(F.get(parts, 0))), "head": F.when(whole, head),
            "http_body": F.when(whole, body)}


def read_katana(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """Captures at the top of a site's folder or one folder below (other hosts)."""
    depth = F.size(F.split("rel", "/"))
    site = F.split_part("rel", F.lit("/"), F.lit(1))
    name = F.lower(name_of(F.col("rel")))
    files = (list_files(spark, root).withColumn("site", site)
             .where(depth.between(2, 3) & visible_site(F.col("site")) & name.endswith(".txt") & ~name.endswith("readme.txt")))
    parts = split_http_text(N.decode_text(unchunked(F.col("body"))))
    rows = (with_body(files, True, partitions).withColumns(parts)
            .where(F.col("url").isNotNull() & (F.col("url") != "")))
    mime = N.content_type(F.col("head"))
    return conform(rows.select(
        N.resource_id(F.col("site")).alias("site"), N.resource_id(F.col("url")).alias("id"), "url",
        N.type_from_mime(mime).alias("type"), N.http_status(F.col("head")).alias("status"),
        F.length("http_body").alias("size"), F.lit(0).alias("time"), F.col("head").alias("headers"),
        F.when(N.is_text(mime), F.col("http_body")).alias("content"),
        F.col("modified").alias("created"), F.col("modified").alias("modified")))

"""File trees as DataFrames.

Listing and reading run inside tasks.  The driver never holds the file list, however
many files a crawl has, and names that start with ``_`` or ``.`` are kept, which
Spark's own file sources leave out (script bundles live in such folders).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.groups import cut

BATCH_BYTES = 16 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024  # that a task reads, about
FILE_BYTES = 64 * 1024  # what opening a file counts for

PAGE = 10_000  # listed files handed on at once

_LISTED = "path string, rel string, length long, modified timestamp, folder boolean"
_LISTED_ARROW = pa.schema([("path", pa.string()), ("rel", pa.string()), ("length", pa.int64()),
                           ("modified", pa.timestamp("us", tz="UTC")), ("folder", pa.bool_())])


def open_filesystem(path: str):
    """(filesystem, path inside it) for a plain path or a URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _entries(system, inside: str) -> Iterator[tuple[str, bool, int, datetime | None]]:
    """Path, whether it is a folder, size and time of what a folder holds; of local folders one by one."""
    from pyarrow import fs

    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
            yield info.path, info.type == fs.FileType.Directory, info.size or 0, info.mtime
        return
    try:
        with os.scandir(inside) as found:
            for entry in found:
                try:
                    folder, state = entry.is_dir(), entry.stat()
                except OSError:  # a link to nothing
                    continue
                yield entry.path, folder, 0 if folder else state.st_size, datetime.fromtimestamp(state.st_mtime, timezone.utc)
    except (FileNotFoundError, NotADirectoryError):
        return


def _expand(recursive: bool):
    """Replace every folder row by what it holds; file rows pass through.  A page of rows and one folder's entries are held at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def children(row: dict) -> Iterator[dict]:
            system, top = open_filesystem(row["path"])
            prefix = row["path"][:len(row["path"]) - len(top)] if row["path"].endswith(top) else ""
            waiting = [top]
            while waiting:
                for path, folder, size, modified in _entries(system, waiting.pop()):
                    if folder and recursive:
                        waiting.append(path)
                        continue
                    below = path[len(top.rstrip("/")) + 1:]
                    yield {"path": prefix + path, "rel": f"{row['rel']}/{below}" if row["rel"] else below, "length": size, "modified": modified, "folder": folder}

        for batch in batches:
            rows: list[dict] = []
            for row in batch.to_pylist():
                for found in children(row) if row["folder"] else [row]:
                    rows.append(found)
                    if len(rows) >= PAGE:
                        yield pa.RecordBatch.from_pylist(rows, _LISTED_ARROW)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, _LISTED_ARROW)
    return run


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def list_level(spark: SparkSession, root: str) -> DataFrame:
    """Direct children of a folder, files and folders."""
    start = spark.createDataFrame([(root.rstrip("/"), "", True)], "path string, rel string, folder boolean")
    start = start.select("path", "rel", F.lit(0).cast("long").alias("length"),
                         F.lit(None).cast("timestamp").alias("modified"), "folder")
    return start.mapInArrow(_expand(False), _LISTED)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder: path, path relative to the folder, length, modification time.

    Two levels are listed one by one and spread over the cluster before the rest is
    walked, so that neither a large site nor a large subfolder of it is one task.
    """
    level = list_level(spark, root)
    for _ in range(2):
        level = level.repartition(_tasks(spark), "path").mapInArrow(_expand(False), _LISTED)
    files = level.repartition(_tasks(spark), "path").mapInArrow(_expand(True), _LISTED)
    return files.drop("folder")


def packed(files: DataFrame, size: Column, by: list[str], target: int = TASK_BYTES) -> DataFrame:
    """The rows of a file list in tasks of about ``target`` bytes of what they stand for, however many files that takes.

    The list is stored and filled into bins group by group: a group is a hash share of the list, small enough for one
    running sum.  ``by`` are columns that tell the rows apart.
    """
    weighed = cut(files.withColumn("_bytes", F.coalesce(size, F.lit(0)).cast("long") + FILE_BYTES))
    total = weighed.agg(F.sum("_bytes")).first()[0] or 0
    groups = max(1, -(-total // (8 * target)))
    order = Window.partitionBy("_group").orderBy(*by)
    placed = weighed.withColumn("_group", F.pmod(F.xxhash64(*by), F.lit(groups))).withColumn("_bin", F.floor((F.sum("_bytes").over(order) - F.col("_bytes")) / target))
    bins = placed.groupBy("_group").agg((F.max("_bin") + 1).alias("_bins"))  # a row for every eight tasks
    first = bins.select("_group", (F.sum("_bins").over(Window.orderBy("_group")) - F.col("_bins")).alias("_first"))
    tasks = bins.agg(F.sum("_bins")).first()[0] or 1
    numbered = placed.join(F.broadcast(first), "_group").withColumn("_task", (F.col("_first") + F.col("_bin")).cast("int"))
    return numbered.repartitionById(int(tasks), F.col("_task")).drop("_bytes", "_group", "_bin", "_first", "_task")


def with_body(files: DataFrame, wanted: Column | bool = True, partitions: int | None = None) -> DataFrame:
    """Add ``body``, the bytes of the wanted files; NULL for the others and for unreadable ones.

    Apply it after everything that narrows the list: it is what costs.  Tasks are filled by the bytes they read.
    """
    flagged = files.withColumn("body", F.lit(None).cast("binary")).withColumn(
        "_read", F.lit(wanted) if isinstance(wanted, bool) else F.coalesce(wanted, F.lit(False)))
    schema = flagged.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def body(path: str) -> bytes | None:
            system, inside = open_filesystem(path)
            try:
                with system.open_input_stream(inside) as stream:
                    return stream.read()
            except OSError:
                return None

        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                if row["_read"]:
                    row["body"] = body(row["path"])
                    held += len(row["body"] or b"")
                rows.append(row)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, batch.schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

    length = F.col("length") if "length" in files.columns else F.lit(0)
    dealt = flagged.repartition(partitions, "path") if partitions else packed(flagged, F.when(F.col("_read"), length), ["path"])
    return dealt.mapInArrow(run, schema).drop("_read")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def below(rel: Column, depth: int) -> Column:
    """Relative path without its first ``depth`` parts."""
    return F.regexp_replace(rel, "^" + "[^/]*/" * depth, "")

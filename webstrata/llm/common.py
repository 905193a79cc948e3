"""What several operators of this package share: the work folder, stored tables, Arrow batches in bounded pieces."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECE_BYTES = 8 << 20  # text handled at once inside a task
FILTER_BITS = 23  # of the filter that lets rows without partners go early: 2 ** 17 rows at most


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local session may lack one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="webstrata-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write a table below the work folder and read it back: cuts lineage and survives lost executors.

    ``by`` names a column of few values whose rows are written apart, so that they can be read apart."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_memory(name: str) -> dict:
    """A dict that lives as long as the Python worker.

    Functions travel to the tasks with fresh copies of their module's names, so what tasks of one worker share is kept
    in a module that every worker has.  Workers outlive a stage: what was kept under other names is let go.
    """
    memory = sys.__dict__.setdefault("_webstrata_memory", {})
    for other in [n for n in memory if n != name]:
        del memory[other]
    return memory.setdefault(name, {})


def released() -> None:
    """Hand free memory back to the system, for a worker that waits for a later stage keeps what it once took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column's text form, modulo ``n`` (NULL ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Shuffle partitions from a row count, at least the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def maybe_among(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands in ``wanted``, and a few others: what is to be joined with it, without most that would find no partner.

    A bit per hashed key, in a table of bounded length.  Keys of different types have different hashes: then all rows stay.
    """
    if docs.schema[key].dataType != wanted.schema[key].dataType:
        return docs
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    word, bit = lambda c: F.shiftright(place(c), 6), lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), 64) as int))")
    bits = wanted.groupBy(word(key).alias("word")).agg(F.bit_or(bit(key)).alias("bits"))
    return docs.withColumn("word", word(key)).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit(key)) != 0).select(*docs.columns)


def quantiles(df: DataFrame, shares: list[float]) -> dict[int, list[float]]:
    """Exact quantiles of ``value`` by ``key``, between two values in proportion; a row counts ``times`` times.

    Ranks come from range partitions of the distinct values: what a partition holds of a key, then running sums in those
    partitions that hold a wanted rank.  No task sees all values of a key; the driver sees a row per key and partition.
    """
    spark = df.sparkSession
    counted = df.groupBy("key", "value").agg(F.sum("times").alias("k"))
    placed = stored(counted.repartitionByRange("key", "value").withColumn("part", F.spark_partition_id()), "quantiles")
    held: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(placed.groupBy("key", "part").agg(F.sum("k").alias("held")).collect(), key=lambda r: (r["key"], r["part"])):
        held.setdefault(r["key"], []).append((r["part"], r["held"]))
    wanted, at = [], {}
    for key, parts in held.items():
        ends = np.cumsum([n for _, n in parts])
        at[key] = [(int(ends[-1]) - 1) * q for q in shares]
        for rank in {int(f(x)) for x in at[key] for f in (np.floor, np.ceil)}:
            part = int(np.searchsorted(ends, rank, side="right"))
            wanted.append((key, parts[part][0], rank, rank - int(ends[part]) + parts[part][1]))
    if not wanted:
        return {}
    ranks = spark.createDataFrame(wanted, "key int, part int, rank long, inside long")
    running = (placed.join(F.broadcast(ranks.select("key", "part").distinct()), ["key", "part"])
               .withColumn("upto", F.sum("k").over(W.partitionBy("key", "part").orderBy("value"))))
    found = {(r["key"], r["rank"]): r["value"] for r in running.join(F.broadcast(ranks), ["key", "part"])
             .where("inside < upto AND inside >= upto - k").select("key", "rank", "value").collect()}
    between = lambda a, b, t: b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t
    return {key: [between(found[key, int(np.floor(x))], found[key, int(np.ceil(x))], x - np.floor(x)) for x in places] for key, places in at.items()}


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of the text column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, NULL as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
         "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
         "array<double>": pa.list_(pa.float64())}


def rows(schema: str, *columns) -> pa.RecordBatch:
    """Columns (Arrow, numpy or lists) as a batch of a schema written as for Spark."""
    fields = [x.split() for x in schema.split(", ")]
    arrays = [c.cast(ARROW[k]) if isinstance(c, pa.Array) else pa.array(c, ARROW[k]) for c, (_, k) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def text_function(build: Callable[[], Callable[[list[bytes]], list]], schema: str) -> Callable[[Column], Column]:
    """A column function from texts to structs.  ``build`` runs once per task and gives what turns a list of texts
    (UTF-8, NULL as empty) into columns of ``schema``.  Texts are handled in pieces of bounded size."""
    fields = [x.split() for x in schema.split(", ")]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = build()
        for column in columns:
            named = pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["text"])
            parts = [work(texts_of(piece, "text")) for piece in pieces([named], "text")]
            arrays = [pa.concat_arrays([pa.array(p[k], ARROW[kind]) for p in parts]) if parts else pa.array([], ARROW[kind])
                      for k, (_, kind) in enumerate(fields)]
            yield pa.StructArray.from_arrays(arrays, names=[n for n, _ in fields])
        work = parts = arrays = None
        released()

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<" + ", ".join(f"{n}: {k}" for n, k in fields) + ">").asNondeterministic()

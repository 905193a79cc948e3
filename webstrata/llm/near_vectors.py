"""Near-duplicate vectors: sign codes of random hyperplanes in several tables, exact cosine, connected components.

Vectors are compared within a label.  Equal vectors are first folded into one representative with a count.  Each table
gives a vector a code of sign bits; vectors that share a code in some table are compared by cosine in double precision,
a pair only in the first table where it meets.  Code length follows the size of the largest label, and the number of
tables follows from it so that a pair exactly at the threshold is missed with a chance of at most ``MISS``.  A code held
by many vectors is split into blocks, and pairs of blocks are handled by different tasks.  A task returns no pairs: each
vector's links counted, and its smallest connected vector within the task, which keeps all connections of the pairs seen.

NULL labels, NULL, empty or zero vectors, and those with a NULL or non-finite component link with nothing and are their
own component; a row whose ``vec_id`` is NULL links with nothing and has a NULL component.  Vectors of different length
never link.  Rows that repeat a vec_id count as one vector if their vectors are equal.  Every row comes back, with its
columns as they were; result columns replace columns of the same name.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, stored
from .components import components

COSINE = 0.93
MISS = 1e-6
BUCKET = 256  # vectors that a code is meant to hold
BLOCK = 512  # vectors of one side of a comparison
PARTIAL = "rep long, links long, root long"


def table_shape(largest: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a code and number of tables for labels of up to ``largest`` vectors."""
    bits = max(2, math.ceil(math.log2(max(1, largest) / BUCKET)) if largest > BUCKET else 2)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def planes(size: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([size, bits, tables]).standard_normal((size, bits * tables))


def codes_of(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (vectors @ planes(vectors.shape[1], bits, tables) >= 0).reshape(len(vectors), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)


def linked_pairs(vectors: np.ndarray, codes: np.ndarray, table: int, side: np.ndarray, cross: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at or above the cosine whose first common table is this one."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if cross else (np.arange(len(unit)),) * 2
    near = unit[left] @ unit[right].T >= cosine
    a, b = np.nonzero(near if cross else np.triu(near, 1))
    a, b = left[a], right[b]
    for earlier in range(table):
        new = codes[a, earlier] != codes[b, earlier]
        a, b = a[new], b[new]
    return a, b


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected with each index."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows with n_links, component_id and kept."""
    spark = vectors.sparkSession
    kind = "<f8" if "double" in dict(vectors.dtypes)["embedding"] else "<f4"
    own = ["n_links", "component_id", "kept"]
    data = vectors.drop(*own)
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0))
    digest = [F.xxhash64("label", "embedding").alias("_h1"), F.xxhash64("embedding", F.lit(3)).alias("_h2")]
    keyed = data.where(F.coalesce(usable, F.lit(False)))
    classes = stored(keyed.select("vec_id", "label", "embedding", *digest).groupBy("_h1", "_h2")
                     .agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("label").alias("label"),
                          F.first("embedding").alias("embedding")), "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_shape(largest, cosine)

    def encode(batches):
        schema = "rep long, label string, copies long, vector binary, codes binary, size int"
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            lengths = np.asarray(pa.compute.list_value_length(batch["embedding"]))
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size)).combine_chunks()
                matrix = part["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, size)
                codes = codes_of(matrix.astype(float), bits, tables).astype("<i4")
                yield rows(schema, part["rep"].combine_chunks(), part["label"].combine_chunks(), part["copies"].combine_chunks(),
                           [v.tobytes() for v in matrix], [c.tobytes() for c in codes], np.full(len(matrix), size))

    coded = (classes.select("rep", F.col("label").cast("string").alias("label"), "copies", "embedding")
             .mapInArrow(encode, "rep long, label string, copies long, vector binary, codes binary, size int"))
    # a table's code: four bytes of ``codes``, kept as they are
    placed = coded.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("code", F.substring("codes", F.col("table") * 4 + 1, F.lit(4)))
    bucket = ["table", "label", "size", "code"]
    crowded = stored(placed.groupBy(*bucket).count().where(F.col("count") > BLOCK), "crowded-codes")
    split = (placed.join(crowded, bucket, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select(*bucket, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "vector", "codes"))

    def compare(key, group):
        table, size, low, high = (key[k].as_py() for k in (0, 2, 4, 5))
        matrix = np.frombuffer(b"".join(group["vector"].to_pylist()), kind).reshape(-1, size).astype(float)
        codes = np.frombuffer(b"".join(group["codes"].to_pylist()), "<i4").reshape(-1, tables)
        rep, copies = group["rep"].to_numpy(), group["copies"].to_numpy().astype(float)
        order = np.argsort(rep)
        matrix, codes, rep, copies, block = matrix[order], codes[order], rep[order], copies[order], group["block"].to_numpy()[order]
        a, b = linked_pairs(matrix, codes, table, block == high, low != high, cosine)
        links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        found = np.flatnonzero(links)
        return pa.Table.from_batches([rows(PARTIAL, rep[found], links[found].astype(np.int64), rep[roots(len(rep), a, b)[found]])])

    partial = stored(split.groupBy(*bucket, "low", "high").applyInArrow(compare, PARTIAL), "vector-links")
    links = partial.groupBy("rep").agg(F.sum("links").alias("links"))
    grouped = components(partial.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-components").withColumnRenamed("node", "rep")
    result = stored(classes.select("_h1", "_h2", "rep", "copies").join(links, "rep", "left").join(grouped, "rep", "left")
                    .select("_h1", "_h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
                    "vector-result")
    out = (data.select("*", *(F.when(F.coalesce(usable, F.lit(False)), d).alias(n) for d, n in zip(digest, ("_h1", "_h2"))))
           .join(result, ["_h1", "_h2"], "left"))
    return out.select(*data.columns, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))

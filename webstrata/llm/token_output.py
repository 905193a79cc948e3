"""Token ids as frequency-ranked numbers in byte-aligned variable-length code with separate control bytes.

File format: a Parquet table whose rows are blocks.  Blocks of a part (``part``, one per writing task) follow each
other by ``block``; parts follow each other by ``part``; documents ascend by ``doc_id`` throughout.  A block holds

* ``doc_ids`` int64 and ``lengths`` uint32, little-endian: its documents and their numbers of ids;
* ``control``: two bits per id, four to a byte, lowest first: the id's rank takes that many bytes plus one;
* ``data``: the ranks, little-endian, in 1 to 4 bytes each.

Rank 0 is the most frequent id of the whole corpus (ties: smaller id).  The table ``ranks`` (id by rank) is as long as
the vocabulary in use and belongs to the files.  NULL and empty texts are the end id alone; repeated and NULL doc_ids
are kept as they are, NULL first and written as the smallest int64; ties are ordered by a hash of their text.
An empty table gives an empty table.  Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, crc_of, pieces, rows, stored, texts_of, tokenizer_path
from .vocabulary import encoder

BLOCK_IDS = 1 << 20
PART_IDS = 16 << 20
NULL_ID = -(1 << 63)
TOKENS = "kind int, doc_id long, tie long, n long, packed binary"
OF_DOCUMENT, OF_ID = 0, 1  # kinds of rows: a document's ids; how often an id (in ``doc_id``) occurs in what a task read
BLOCKS = "part int, block int, before long, n_ids long, doc_ids binary, lengths binary, control binary, data binary"
# bytes of each of a control byte's four numbers
WIDTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative numbers below 2**32."""
    ranks = np.asarray(ranks, dtype="<u4")
    width = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = width - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < width[:, None]]
    return control.tobytes(), data.tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers of a block: widths come from a table over control bytes, values from shifted gathers."""
    width = WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(width) - width
    out = raw[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        wide = np.flatnonzero(width > k)
        if not len(wide):
            break
        out[wide] |= raw[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenized(docs: DataFrame, path: str, end_id: int, vocabulary: int) -> DataFrame:
    """The ids of each document, packed and compressed, and each task's counts of ids: at most as many rows as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, codec = encoder(path), pa.Codec("zstd", compression_level=1)
        kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
        total = np.zeros(vocabulary, np.int64)
        for batch in pieces(batches, "text"):
            ids, counts = coder.encode(texts_of(batch, "text"), end_id)
            total += np.bincount(ids, minlength=vocabulary)
            ids, ends = ids.astype(kind), np.cumsum(counts)
            packed = [codec.compress(ids[a:b].tobytes(), asbytes=True) for a, b in zip(ends - counts, ends)]
            yield rows(TOKENS, np.full(len(counts), OF_DOCUMENT), column_of(batch, "doc_id"), column_of(batch, "tie"), counts, packed)
        seen = np.flatnonzero(total)
        yield rows(TOKENS, np.full(len(seen), OF_ID), seen, pa.nulls(len(seen)), total[seen], pa.nulls(len(seen)))

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, TOKENS)


def unpack(codec: pa.Codec, packed: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(codec.decompress(packed, n * np.dtype(kind).itemsize), kind)


def write_token_files(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, np.ndarray]:
    """The block table of a corpus, stored, and the ids by rank."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    both = stored(tokenized(docs, path, end_id, vocabulary), "tokens", "none", by="kind")
    tokens = both.where(F.col("kind") == OF_DOCUMENT)
    counts = both.where(F.col("kind") == OF_ID).groupBy(F.col("doc_id").alias("id")).agg(F.sum("n").alias("n")).toPandas()  # one row per id at most
    ranked = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype=np.int64)
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)
    parts = max(1, -(-int(counts["n"].sum()) // PART_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, codec = TaskContext.get().partitionId(), 0, 0, pa.Codec("zstd")
        docs, lengths, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, docs, lengths, held, size
            control, data = encode_block(shared.value[np.concatenate(held)])
            row = [part, block, before, size, np.array(docs, "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), control, data]
            block, before = block + 1, before + size
            docs, lengths, held, size = [], [], [], 0
            return rows(BLOCKS, *([x] for x in row))

        for batch in batches:
            for doc, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs.append(NULL_ID if doc is None else doc)
                lengths.append(n)
                held.append(unpack(codec, packed, n, kind))
                size += n
                if size >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    ordered = (tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "n", "packed"))
    blocks = stored(ordered.mapInArrow(run, BLOCKS), "token-files", "none")
    return blocks, ranked


def read_token_files(blocks: DataFrame, ranked: np.ndarray, keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(ranked.astype(np.uint32))
    # one row per written part: a few numbers for every PART_IDS ids, read from the narrow columns only
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    starts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ids = shared.value[decode_block(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(lengths)
                each = [ids[a:b] for a, b in zip(ends - lengths, ends)]
                columns = [np.full(len(docs), row["part"]), pa.array(docs, mask=docs == NULL_ID), row["before"] + ends - lengths, lengths,
                           [crc_of(x) for x in each]]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int64())))
                yield rows(schema, *columns)

    found = blocks.mapInArrow(run, schema).join(F.broadcast(starts), "part")
    return found.select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), *found.columns[3:5 + keep_ids])


def token_digest(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Write the corpus as token files and describe each document from the files read back."""
    blocks, ranked = write_token_files(docs, tokenizer_path(vocabulary), end_id)
    return read_token_files(blocks, ranked, keep_ids=False)

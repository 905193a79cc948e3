"""Vector code compression: product codes found in the domain of an integer Walsh-Hadamard transform.

Components become the integers ``floor(scale * x)``.  A vector is cut into equal parts, each coded by the nearest entry
of its position's codebook.  Parts and entries are padded with zeros to a power of two and transformed with the
unnormalised Walsh-Hadamard matrix, whose rows are taken in sequency order (by number of sign changes).  The transform
multiplies every squared distance by the padded length, so sums over the leading coefficients bound it from below: after
a few of them the best entry so far is measured in full, and every entry whose sum exceeds that is dropped, coefficient by
coefficient.  All arithmetic is in integers; where 64 bits might not do, in Python's unbounded ones.  Ties go to the lower
index.

Every round is one pass over the stored vectors with the codebooks (a few numbers per entry) sent along, and one sum per
entry from every task; nothing that grows with the table reaches the driver.

Rows whose vector is NULL, empty, or holds a NULL or non-finite component are dropped.  All vectors must be as long as
that of the first kept row (by vec_id, NULL last, then by vector); those of another length are dropped too.  Lengths that the
number of parts does not divide are padded with zeros.  Repeated rows count as often as they occur; the codebooks start
from the first rows in that order, fewer if there are fewer.  Sums of squares beyond a long are NULL.  NULL labels belong
together.  An empty table, or one without a usable vector, gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LEADING = 4  # a fourth of the coefficients is summed for all entries before the first are dropped
ROWS = 4096  # parts compared at once
HOT_LABELS = 256  # labels that hold more than this fraction of the rows are joined apart
SAFE = 1 << 60  # largest sum of squares left to 64-bit arithmetic


def transform(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of the last axis (a power of two long), in natural order."""
    x, n, half = x.copy(), x.shape[-1], 1
    while half < n:
        pair = x.reshape(*x.shape[:-1], n // (2 * half), 2, half)
        x = np.stack([pair[..., 0, :] + pair[..., 1, :], pair[..., 0, :] - pair[..., 1, :]], axis=-2).reshape(x.shape)
        half *= 2
    return x


def sequency(n: int) -> np.ndarray:
    """Rows of the natural order by their number of sign changes."""
    matrix = transform(np.eye(n, dtype=np.int64))
    return np.argsort((matrix[:, 1:] != matrix[:, :-1]).sum(axis=1), kind="stable")


def spectrum(parts: np.ndarray) -> np.ndarray:
    """Zero-padded and transformed last axis, in sequency order."""
    size = parts.shape[-1]
    padded = 1 << max(0, size - 1).bit_length()
    zeros = np.zeros((*parts.shape[:-1], padded - size), parts.dtype)
    return transform(np.concatenate([parts, zeros], axis=-1))[..., sequency(padded)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and scaled squared distance of each part, both given as spectra."""
    n, size = parts.shape
    lead = -(-size // LEADING)
    partial = np.zeros((n, len(entries)), parts.dtype)
    for c in range(lead):
        partial += (parts[:, c, None] - entries[None, :, c]) ** 2
    guess = partial.argmin(axis=1)
    bound = ((parts - entries[guess]) ** 2).sum(axis=1)
    at, entry = np.nonzero(partial <= bound[:, None])
    total = partial[at, entry]
    for c in range(lead, size):
        total = total + (parts[at, c] - entries[entry, c]) ** 2
        alive = total <= bound[at]
        at, entry, total = at[alive], entry[alive], total[alive]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # every part keeps its guess at least
    least = np.minimum.reduceat(total, first)
    best = np.flatnonzero(total == np.repeat(least, np.diff(np.append(first, len(at)))))
    best = best[np.append(True, at[best][1:] != at[best][:-1])]
    return entry[best], least


def integers(scaled: np.ndarray, parts: int) -> np.ndarray:
    """Whole numbers given as doubles, cut into parts (zeros at the end), as 64-bit integers where squares cannot overflow."""
    n, size = scaled.shape
    each = -(-size // parts)
    largest = int(np.abs(scaled).max(initial=0))
    padded = 1 << max(0, each - 1).bit_length()
    whole = scaled.astype(np.int64) if padded * (2 * padded * largest) ** 2 <= SAFE else np.array([[int(v) for v in row] for row in scaled.tolist()], object).reshape(n, size)
    return np.concatenate([whole, np.zeros((n, each * parts - size), whole.dtype)], axis=1).reshape(n, parts, each)


def assigned(vectors: np.ndarray, books: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of every part of every vector."""
    n, parts, each = vectors.shape
    entries = np.array(books, object)
    padded = 1 << max(0, each - 1).bit_length()
    largest = max((abs(v) for v in entries.ravel()), default=0)
    narrow = vectors.dtype != object and padded * (2 * padded * largest) ** 2 <= SAFE
    kind = np.int64 if narrow else object
    vectors, entries = vectors.astype(kind), spectrum(entries.astype(kind))
    found = [nearest(spectrum(vectors[:, p]), entries[p]) for p in range(parts)]
    return np.stack([f[0] for f in found], axis=1).reshape(n, parts), np.stack([f[1] // padded for f in found], axis=1).reshape(n, parts)


def whole_vectors(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            piece = batch.slice(a, ROWS)
            column = piece.column(piece.schema.get_field_index("scaled")).to_pylist()
            yield piece, integers(np.stack([np.frombuffer(x, "<f8") for x in column]), parts)


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and the scaled, floored components (doubles that are whole numbers) of the rows that can be coded."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) != float("inf"))
    kept = (vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
            .where(F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite), F.lit(False))))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).first()
    size = first[0] if first else 0

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size) * scale).astype("<f8")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in matrix], pa.binary())],
                                                 names=["vec_id", "label", "scaled"])

    kinds = dict(kept.dtypes)
    return stored(kept.where(F.size("embedding") == size).mapInArrow(scaled, f"vec_id {kinds['vec_id']}, label {kinds['label']}, scaled binary"), "scaled-vectors")


def moved(data: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after one round: entries in use become the floored means of their parts."""
    parts, k = len(books), len(books[0])
    schema = "part int, entry int, n long, total string"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, k), np.int64), np.zeros((parts, k, len(books[0][0])), object)
        for _, whole in whole_vectors(batches, parts):
            codes, _ = assigned(whole, books)
            for p in range(parts):
                own = codes[:, p] == np.arange(k)[:, None]
                counts[p] += own.sum(axis=1)
                totals[p] += own.astype(whole.dtype) @ whole[:, p]
        used = list(zip(*np.nonzero(counts)))
        yield rows(schema, [int(p) for p, _ in used], [int(e) for _, e in used], [int(counts[x]) for x in used], [_joined(totals[x]) for x in used])

    def merge(table: pa.Table) -> pa.Table:  # one row from each task
        total = [sum(column) for column in zip(*(map(int, x.split(",")) for x in table["total"].to_pylist()))]
        return pa.Table.from_batches([rows(schema, table["part"][:1].combine_chunks(), table["entry"][:1].combine_chunks(),
                                           [sum(table["n"].to_pylist())], [_joined(total)])])

    made = [[list(entry) for entry in book] for book in books]
    for row in data.mapInArrow(sums, schema).groupBy("part", "entry").applyInArrow(merge, schema).collect():  # as many rows as entries
        made[row["part"]][row["entry"]] = [int(v) // row["n"] for v in row["total"].split(",")]
    return made


def _joined(numbers) -> str:
    return ",".join(map(str, numbers))


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(_joined(v for book in books for entry in book for v in entry).encode()).hexdigest()


def coded(data: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """vec_id, label, code (an index per part, two hex digits each) and error (squared distances of all parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, whole in whole_vectors(batches, len(books)):
            codes, errors = assigned(whole, books)
            total = [int(e) for e in errors.sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]),
                 pa.array([e if e < 1 << 63 else None for e in total], pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(data.dtypes)
    return data.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_error(made: DataFrame) -> DataFrame:
    """The rows with the sum of error over their label, NULL if one of them is."""
    made = stored(made, "vector-codes")
    totals = stored(made.groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.col("error").cast("decimal(38,0)")).alias("total"),
                                              F.bool_or(F.col("error").isNull()).alias("broken"))
                    .select(F.col("label").alias("of_label"), "rows", F.when(~F.col("broken"), F.col("total").try_cast("long")).alias("label_error")), "label-errors")
    n = made.count()
    hot, rest = totals.where(F.col("rows") * HOT_LABELS > n), totals.where(F.col("rows") * HOT_LABELS <= n)
    same = F.col("label").eqNullSafe(F.col("of_label"))
    hot = F.broadcast(hot)  # fewer than HOT_LABELS labels can be that frequent
    found = made.join(hot, same).drop("of_label", "rows")
    return found.union(made.join(hot, same, "left_anti").join(rest, same).drop("of_label", "rows"))


def transform_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                    scale: int = SCALE) -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, label, code, error and label_error of every usable vector, and the final codebooks (part, entry, component)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has room for 1 to 256 entries")
    data = usable(vectors, scale)
    start = data.orderBy(F.asc_nulls_last("vec_id"), "scaled").limit(entries).select("scaled").collect()
    books: list[list[list[int]]] = []
    if start:
        whole = integers(np.stack([np.frombuffer(r["scaled"], "<f8") for r in start]), parts)
        books = whole.swapaxes(0, 1).tolist()
        for _ in range(rounds):
            books = moved(data, books)
    return with_label_error(coded(data, books)), books

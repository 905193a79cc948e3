"""Hierarchical packing of documents into windows of several context sizes.

Each task packs the documents of its own input split, so nothing is shuffled.  A document's ids, closed by the end
id, are routed by length: full longest windows are cut off first, the rest goes to the smallest tier it fits.  From the
longest tier down, each window starts with one document of its tier and its gap is filled from shorter tiers, whole
pieces first, then one cut to measure, so that a window of any tier is full to its last place.  What a task has left at
its end fills longest windows in turn, and its last fragment exact shorter ones; only one window per task is padded.

Windows of one tier are dealt into step groups of equally many ids, so that the groups of a round carry similar
attention work (sum of squared piece lengths); a task's last group of a tier may be short.

NULL and empty texts are the end id alone.  Repeated rows and NULL doc_ids are packed like any other.  An empty table
gives no pieces.  Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, crc_of, pieces, released, rows, texts_of
from .vocabulary import encoder

TIERS = (256, 512, 1024, 2048)
STEP_IDS = 64 << 10
POOL_IDS = 4 << 20  # ids packed at once inside a task
ENCODED_BYTES = 2 << 20  # text encoded at once
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "context int, step_group long")

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, ids of the whole document


class Packer:
    """Windows of one task; ``add`` documents, ``take`` finished windows as (context, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.longest = tiers, tiers[-1]
        self.waiting: list[list[Piece]] = [[] for _ in tiers]
        self.held = [0] * len(tiers)  # ids waiting in each tier
        self.done: list[tuple[int, list[Piece]]] = []

    def _route(self, piece: Piece) -> None:
        k = next(k for k, t in enumerate(self.tiers) if len(piece[2]) <= t)
        self.waiting[k].append(piece)
        self.held[k] += len(piece[2])

    def _pop(self, k: int) -> Piece:
        piece = self.waiting[k].pop()
        self.held[k] -= len(piece[2])
        return piece

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, full = len(ids), len(ids) // self.longest * self.longest
        for a in range(0, full, self.longest):
            self.done.append((self.longest, [(doc, a, ids[a:a + self.longest], n)]))
        if full < n:
            self._route((doc, full, ids[full:], n))

    def _next(self, gap: int, top: int) -> Piece | None:
        """A piece for a gap: the longest tier that surely fits, else the nearest one above it, up to ``top``."""
        fits = [k for k in range(top + 1) if self.waiting[k]]
        below = [k for k in fits if self.tiers[k] <= gap]
        if not fits:
            return None
        piece = self._pop(below[-1] if below else fits[0])
        doc, start, ids, n = piece
        if len(ids) > gap:
            self._route((doc, start + gap, ids[gap:], n))
            return doc, start, ids[:gap], n
        return piece

    def _window(self, context: int, first: list[Piece], top: int) -> list[Piece]:
        gap = context - sum(len(p[2]) for p in first)
        while gap and (piece := self._next(gap, top)):
            first.append(piece)
            gap -= len(piece[2])
        return first

    def pack(self, last: bool = False) -> None:
        """Close every window that can be filled; with ``last``, all of them."""
        for k in range(len(self.tiers) - 1, -1, -1):
            context = self.tiers[k]
            while self.waiting[k] and sum(self.held[:k + 1]) >= context:
                self.done.append((context, self._window(context, [self._pop(k)], k)))
        if last:
            total = sum(self.held)
            for context in [self.longest] * (total // self.longest) + [t for t in self.tiers[-2::-1] if total % self.longest & t]:
                self.done.append((context, self._window(context, [], len(self.tiers) - 1)))
            if tail := self._window(self.tiers[0], [], len(self.tiers) - 1):
                self.done.append((self.longest, tail))

    def take(self) -> list[tuple[int, list[Piece]]]:
        done, self.done = self.done, []
        return done


def deal(work: list[int], groups: int) -> np.ndarray:
    """Group of each window: heaviest first, back and forth over the groups."""
    order = np.argsort(-np.asarray(work), kind="stable")
    turn = np.arange(len(work)) % (2 * groups)
    out = np.empty(len(work), np.int64)
    out[order] = np.where(turn < groups, turn, 2 * groups - 1 - turn)
    return out


def pack_documents(docs: DataFrame, path: str, end_id: int, tiers: tuple[int, ...] = TIERS,
                   step_ids: int = STEP_IDS, keep_ids: bool = False) -> DataFrame:
    """One row per piece; with ``keep_ids`` its ids too."""
    schema = PIECES + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, task = encoder(path), Packer(tiers), TaskContext.get().partitionId() << 32
        open_windows: dict[int, list[list[Piece]]] = {t: [] for t in tiers}
        sequences = groups = 0

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups
            packer.pack(last)
            for context, window in packer.take():
                open_windows[context].append(window)
            for context, windows in open_windows.items():
                per = max(1, step_ids // context)
                n = len(windows) if last else len(windows) // per * per
                if not n:
                    continue
                count = -(-n // per)
                group = deal([sum(len(p[2]) ** 2 for p in w) for w in windows[:n]], count)
                yield batch_of(windows[:n], context, group + groups)
                sequences, groups = sequences + n, groups + count
                open_windows[context] = windows[n:]

        def batch_of(windows: list[list[Piece]], context: int, group: np.ndarray) -> pa.RecordBatch:
            flat = [p for w in windows for p in w]
            of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            length = np.array([len(p[2]) for p in flat], np.int64)
            before = np.cumsum(length) - length
            first = np.append(True, np.diff(of) > 0)
            offset = before - np.maximum.accumulate(np.where(first, before, 0))
            columns = [[p[0] for p in flat], [p[1] for p in flat], length, [crc_of(p[2]) for p in flat], [p[3] for p in flat],
                       task + sequences + of, offset, np.full(len(flat), context), task + group[of]]
            if keep_ids:
                ends = np.append(0, np.cumsum(length))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([p[2] for p in flat]), pa.int32())))
            return rows(schema, *columns)

        pool = 0
        for batch in pieces(batches, "text"):
            for part in pieces([batch], "text", ENCODED_BYTES):
                ids, counts = coder.encode(texts_of(part, "text"), end_id)
                ends = np.cumsum(counts)
                for doc, a, b in zip(column_of(part, "doc_id").to_pylist(), ends - counts, ends):
                    packer.add(doc, ids[a:b])
                pool += len(ids)
            if pool >= POOL_IDS:
                yield from emit(False)
                pool = 0
        yield from emit(True)
        released()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)

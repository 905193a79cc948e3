"""SentencePiece encoding and decoding with Viterbi paths shared between words of one beginning.

A text gets a leading space mark, its spaces become marks, and it is cut before each run of marks; pieces never cross such
a cut.  Distinct words are sorted, which visits the trie of their prefixes depth-first: each word keeps the forward
states of the prefix it shares with the word before and only computes the rest.  Then paths are read backwards.

* Unigram models: the state of a prefix is its best score and the piece that ends it; scores add up, and of equal
  scores the longer last piece wins.
* BPE models: a sequence of pieces is what merging gives if and only if each neighbouring pair is what merging gives for
  the two together, so a path scores 0 or is impossible, exactly one is possible, and the state is the last piece.

Letters without a piece become byte pieces, or one unknown id per run of them.  Only models without normalisation rules and
with pieces that hold marks at their beginning alone are accepted; others raise ``ValueError``.  NULL and empty
texts have no ids.  Repeated rows are encoded alike, extra columns are ignored, and an empty table gives no rows.
Decoding gives the text back exactly, but for a space mark in the text itself, which becomes a space.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, crc_of, pieces, rows, text_function, texts_of, worker_memory
from .vocabulary import WordEncoder

MARK = "▁"
UNKNOWN_PENALTY = 10.0
PAIRS_KEPT = 1_000_000
_NEVER = float("-inf")
DIGEST = "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, round_trip boolean"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceModel:
    """Pieces, scores and the forward step of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:  # a vocabulary installed on every machine
            model.ParseFromString(file.read())
        self._set_up(model)

    def _set_up(self, model) -> None:
        kind = model.trainer_spec.model_type
        if kind not in (1, 2) or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces \
                or not model.normalizer_spec.add_dummy_prefix or not model.normalizer_spec.escape_whitespaces:
            raise ValueError("only unigram and BPE models without normalisation rules")
        self.merging = kind == 2
        types = [p.type for p in model.pieces]
        self.names = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.ids = {p: k for k, (p, t) in enumerate(zip(self.names, types)) if t == 1}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(t in (4, 5) for t in types):
            raise ValueError("only models whose pieces hold marks at their beginning, and without user-defined pieces")
        self.bytes = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(self.names, types)) if t == 6}
        self.unknown = types.index(2)
        self.merges = {p: self.scores[k] for p, k in self.ids.items()}
        self.longest: dict[str, int] = {}  # of the pieces with a given ending of two letters
        for p in self.ids:
            self.longest[p[-2:]] = max(len(p), self.longest.get(p[-2:], 1))
        lowest = min((self.scores[k] for k in self.ids.values()), default=0.0)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self._fits: dict[tuple[str, str], bool] = {}
        # what each id adds to a text
        self.out = [bytes([int(p[3:5], 16)]) if t == 6 else b" \xe2\x81\x87 " if t == 2 else b"" if t == 3 else p.replace(MARK, " ").encode()
                    for p, t in zip(self.names, types)]

    def merged(self, text: str) -> list[str]:
        """What merging gives for a short text: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        gain = [self.merges.get(x + y, _NEVER) for x, y in zip(parts, parts[1:])]
        while gain and (best := max(gain)) > _NEVER:
            k = gain.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del gain[k]
            if k:
                gain[k - 1] = self.merges.get(parts[k - 1] + parts[k], _NEVER)
            if k < len(gain):
                gain[k] = self.merges.get(parts[k] + parts[k + 1], _NEVER)
        return parts

    def fits(self, left: str, right: str) -> bool:
        key = left, right
        if key not in self._fits:
            if len(self._fits) >= PAIRS_KEPT:
                self._fits.clear()
            self._fits[key] = self.merged(left + right) == [left, right] if left else self.merged(right) == [right]
        return self._fits[key]

    def paths(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the words, which must be sorted and distinct."""
        start, score, before = [0], [0.0], ""
        get, longest = self.ids.get, self.longest.get
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del start[shared + 1:], score[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                best, origin = None, end - 1
                for begin in range(max(0, end - longest(word[max(0, end - 2):end], 1)), end):
                    piece = word[begin:end]
                    found = get(piece)
                    if found is None:
                        if begin < end - 1 or best is not None and not self.merging:
                            continue
                        if self.merging:
                            best, origin = 0.0, begin
                            break
                        best, origin = score[begin] + self.unknown_score, begin
                    elif self.merging:
                        left = word[start[begin]:begin]
                        if self.fits(left if left in self.ids else "", piece):
                            best, origin = 0.0, begin
                            break
                    elif best is None or score[begin] + self.scores[found] > best:
                        best, origin = score[begin] + self.scores[found], begin
                start.append(origin)
                score.append(best or 0.0)
            before = word
            yield self._read(word, start)

    def _read(self, word: str, start: list[int]) -> list[int]:
        out, end = [], len(word)
        while end:
            begin = start[end]
            found = self.ids.get(word[begin:end])
            if found is not None:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(word[begin:end].encode()))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            end = begin
        return out[::-1]

    def decode(self, ids) -> str:
        text = b"".join([self.out[k] for k in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class PieceEncoder(WordEncoder):
    """Ids of whole texts; words that were met before are looked up."""

    def __init__(self, path: str, limit: int = 600_000):
        self.model, self.limit = PieceModel(path), limit
        self._start()

    def words(self, text: bytes) -> list[str]:
        return _WORDS.findall(MARK + text.decode("utf-8", "replace").replace(" ", MARK)) if text else []

    def _numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.words(t) for t in texts]
        counts = np.array([len(x) for x in split], dtype=np.int64)
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum())), counts

    def _learn(self, known: int) -> None:
        new = sorted(list(self.index)[known:])
        self._grow()
        paths = list(self.model.paths(new))
        lengths = np.array([len(p) for p in paths], np.int64)
        flat = np.fromiter((k for p in paths for k in p), np.int32, int(lengths.sum()))
        self._append(np.array([self.index[w] for w in new]), flat, np.cumsum(lengths) - lengths, lengths)

    def ids_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.encode(texts, -1)
        return ids[ids >= 0], counts - 1


def piece_encoder(path: str) -> PieceEncoder:
    known = worker_memory("piece encoders")
    if path not in known:
        known[path] = PieceEncoder(path)
    return known[path]


def encoded(text: Column, path: str) -> Column:
    """A struct with the ids of a text column."""

    def build():
        coder = piece_encoder(path)

        def work(texts: list[bytes]) -> list:
            ids, counts = coder.ids_of(texts)
            return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))]
        return work

    return text_function(build, "ids array<int>")(text)


def decoded(ids: Column, path: str) -> Column:
    """The texts of a column of ids; NULL stays NULL."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = piece_encoder(path).model
        for column in columns:
            yield pa.array([None if x is None else model.decode(x) for x in column.to_pylist()], pa.string())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ids)


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """Each document encoded and decoded again: number and checksum of its ids, checksum of the text that they give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(path)
        for batch in pieces(batches, "text"):
            texts = texts_of(batch, "text")
            ids, counts = coder.ids_of(texts)
            ends = np.cumsum(counts)
            each = [ids[a:b] for a, b in zip(ends - counts, ends)]
            back = [coder.model.decode(x.tolist()).encode() for x in each]
            yield rows(DIGEST, column_of(batch, "doc_id"), counts, [crc_of(x) for x in each], [zlib.crc32(b) for b in back],
                       [a == b for a, b in zip(texts, back)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST)

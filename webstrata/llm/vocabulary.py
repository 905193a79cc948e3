"""Encoding of texts with a word-level BPE file: each distinct word goes through the tokenizer once per worker."""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged, worker_memory

SPECIAL = b"<|"  # how the special tokens of the vocabulary begin
TOGETHER = 256  # words given to the tokenizer at once
# letters, then marks that the tokenizer splits off as one word (no apostrophe, nothing that begins a special token)
_MARKED = re.compile(rb"""([^\x00-\x40\x5b-\x60\x7b-\x7f]+)([]!"#$%&()*+,./:;=?@[\\^_`{}~-]+)""")


class _Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class WordEncoder:
    """Ids of whole texts for a lower-casing vocabulary whose tokens never cross white space.

    Texts are split at ASCII white space; the ids of a text are those of its words in order, so a table of words and their
    ids, kept between batches, replaces most of the work.  A batch is first reduced to its distinct words.  At ``limit``
    words the table lets go of those that were met only once.
    """

    def __init__(self, path: str, limit: int = 500_000):
        # one text at a time: threads would only take memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        # words of small ASCII letters need none of the file's normalising and splitting
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.split_id = self.tokenizer.token_to_id("<|endoftext|>")
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._start()

    def _start(self) -> None:
        self.index = _Numbered()
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0
        self.starts, self.lengths, self.uses = (np.zeros(1 << 18, np.int64) for _ in range(3))

    def _grow(self) -> None:
        while len(self.index) > len(self.starts):
            self.starts, self.lengths, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.uses))

    def _trim(self) -> None:
        """Keep the words that were met more than once, the half of ``limit`` met most often at most."""
        uses = self.uses[:len(self.index)]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[:self.limit // 2]])
        chosen = np.zeros(len(uses), bool)
        chosen[keep] = True
        self.index = _Numbered((w, n) for n, w in enumerate(w for w, c in zip(self.index, chosen.tolist()) if c))
        lengths = self.lengths[keep]
        ids = self.ids[ragged(self.starts[keep], lengths)]
        self.ids, self.used = np.concatenate([ids, np.zeros(max(1 << 20, len(ids)), np.int32)]), len(ids)
        self.starts, self.lengths, self.uses = (np.concatenate([x, np.zeros(max(1 << 18, len(x)), np.int64)]) for x in (np.cumsum(lengths) - lengths, lengths, uses[keep] // 2))

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        if SPECIAL in text:  # special tokens are matched with case
            return [w if SPECIAL in w else w.lower() for w in text.split()]
        return text.lower().split()

    def _learn(self, known: int) -> None:
        """Ids of the words numbered since there were ``known``."""
        ascii_words, single, marked, other = [], [], [], []

        def letters(w: bytes) -> bool:  # also in their small form, which may be more than one character
            return w.isalpha() or w.decode("utf-8", "replace").lower().isalpha()

        def kind(w: bytes) -> list[bytes]:
            return ascii_words if w.isalpha() else single if letters(w) else other

        for w in list(islice(self.index, known, None)):
            parts = None if w.isalpha() else _MARKED.fullmatch(w)
            if parts is not None and letters(parts[1]):
                marked.append((w, parts[1], parts[2]))
            else:
                kind(w).append(w)
        bare = len(self.index)
        marked = [(self.index[w], self.index[core], self.index[marks]) for w, core, marks in marked]
        for w in islice(self.index, bare, None):
            kind(w).append(w)
        self._grow()
        for a in range(0, len(ascii_words), TOGETHER):
            part = ascii_words[a:a + TOGETHER]
            ids = self._encode(b" ".join(part).decode(), self.bare)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            self._put(part, ids, np.append(0, ends[:-1]), ends)
        for a in range(0, len(single), TOGETHER):
            part = single[a:a + TOGETHER]
            ids = self._encode(" ".join(w.decode("utf-8", "replace") for w in part))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part):
                self._put(part, ids, np.append(0, ends[:-1]), ends)
            else:  # a letter whose small form is no single letter
                other += part
        plain = [w for w in other if SPECIAL not in w]
        for a in range(0, len(plain), TOGETHER):
            part = plain[a:a + TOGETHER]
            ids = self._encode("<|endoftext|>".join(w.decode("utf-8", "replace") for w in part))
            ends = np.append(np.flatnonzero(ids == self.split_id), len(ids))
            self._put(part, ids, np.append(0, ends[:-1] + 1), ends)
        for w in other:
            if SPECIAL in w:
                ids = self._encode(w.decode("utf-8", "replace"))
                self._put([w], ids, np.array([0]), np.array([len(ids)]))
        if marked:
            own, core, marks = (np.array(x) for x in zip(*marked))
            both = np.stack([core, marks], axis=1).ravel()
            lengths = self.lengths[core] + self.lengths[marks]
            self._append(own, self.ids[ragged(self.starts[both], self.lengths[both])], np.cumsum(lengths) - lengths, lengths)

    def _encode(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _put(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self._append(np.array([self.index[w] for w in words]), ids, starts, ends - starts)

    def _append(self, numbers: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[numbers], self.lengths[numbers] = starts + self.used, lengths
        self.used += len(ids)

    def _numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts (empty ones among them), and how many each text has."""
        if any(SPECIAL in t for t in texts):
            split = [self.words(t) for t in texts]
            counts = np.array([len(x) for x in split], dtype=np.int64)
            flat = pa.array([w for x in split for w in x], pa.binary())
        else:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string())))
            counts, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().cast(pa.binary())
        distinct = flat.dictionary_encode()
        own = np.fromiter(map(self.index.__getitem__, distinct.dictionary.to_pylist()), dtype=np.int64, count=len(distinct.dictionary))
        return own[distinct.indices.to_numpy()] if len(own) else np.zeros(0, np.int64), counts

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by ``end_id``, and the number of ids of each text."""
        if len(self.index) > self.limit:
            self._trim()
        known = len(self.index)
        flat, counts = self._numbered(texts)
        if len(self.index) > known:
            self._learn(known)
        self.uses[:len(self.index)] += np.bincount(flat, minlength=len(self.index))
        lengths = self.lengths[flat]
        ends = np.append(0, np.cumsum(lengths))
        last = np.cumsum(counts)
        totals = ends[last] - ends[last - counts] + 1
        out = np.full(int(totals.sum()), end_id, dtype=np.int32)
        keep = np.ones(len(out), dtype=bool)
        keep[np.cumsum(totals) - 1] = False
        out[keep] = self.ids[ragged(self.starts[flat], lengths)]
        return out, totals


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file; its word table lives as long as the worker."""
    known = worker_memory("encoders")
    if path not in known:
        known[path] = WordEncoder(path)
    return known[path]

"""Sets of word shingles as 64-bit hashes."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

WORDS = 5
_FACTOR = np.uint64(0x9FB21C651E98DF25)
_MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_KEPT = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted.

    A-Z are lower-cased and words are split at ASCII white space; a shingle is the hash of ``words`` of them in order.  A
    shorter text is one shingle of all its words, one without words has none.  Two different shingles are taken for
    the same with a chance of 2**-64.
    """
    split = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    folded = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for k in range(words):
        folded = folded * _FACTOR + flat[k:len(folded) + k]
    folded = mixed(folded)
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        if b - a >= words:
            out.append(np.unique(folded[a:b - words + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for h in flat[a:b]:
                short = short * _FACTOR + h
            out.append(mixed(np.array([short ^ _MIX[1]], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Language identification with unigram piece models that sum over all segmentations of a word.

Pieces come from a fixed public vocabulary.  For each language, piece probabilities are learnt by expectation
maximisation over word counts of training documents; a word's probability is the sum over all ways to cut it into
pieces (forward algorithm), a document's that of its words times the language's share of the training documents.

Words are runs of letters and of the marks that combine with them, lower-cased, with a mark in front, however long: the
forward array is rescaled on its way.  NULL texts and texts without a letter are ``und`` with score 0.  Ties go to the first language in
alphabetical order.  The posterior only compares the learnt languages; whether a text is in any of them is told by its
fit, the mean log probability a letter under the language found, less the least that the language's training documents
let expect (``floor``).  ``kept`` asks for both.  Repeated rows are scored alike; extra columns pass through ``identify`` untouched.  Training rows
with NULL language or text are left out; with no training rows at all every document is ``und``.  Every language of the
training rows is learnt, from all of them; the driver and the tasks hold one number per piece and language.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, quantiles, released, rows, stored, text_function, texts_of, worker_memory

ROUNDS = 3
CELLS = 500_000  # numbers of a forward array, about
RESCALE = 8  # positions after which a forward array is rescaled
WORDS_KEPT = 400_000  # words whose probabilities a worker remembers
MARK = "▁"
KEEP_AT = 0.5
#: The floor lies this many times as far below the median fit as the low quantile, and so many shares of the median below it, at least and at most.
LOW, TIMES, LEAST, MOST = 0.01, 3, 0.25, 0.75
PREDICTED = "lang_pred string, score double"
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT, _SLOTS = np.uint64(0xD6E8FEB86659FD93), 20
#: ASCII letters as they are, anything else as a blank
_ASCII = bytes(k if chr(k).isalpha() and k < 128 else 32 for k in range(256))
_OTHER, _LETTER, _JOINED = 0, 1, 2  # what a character is to words; marks only join letters


def _kinds() -> np.ndarray:
    """The kind of each character."""
    known = worker_memory("language pieces")
    if "kinds" not in known:
        kinds = np.zeros(sys.maxunicode + 1, np.uint8)
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
        place = lambda k: k + 0x800 * (k >= 0xD800)  # noqa: E731  surrogates are no characters
        for run in _LETTERS.finditer(every):
            kinds[place(run.start()):place(run.end() - 1) + 1] = [_LETTER if c.isalpha() else _JOINED for c in run[0]]
        known["kinds"] = kinds
    return known["kinds"]


def words_of(text: bytes) -> list[str]:
    """Runs of letters and marks that hold a letter, in lower case."""
    if text.isascii():
        return text.translate(_ASCII).decode("ascii").lower().split()
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    kinds = _kinds()[points]
    words = np.where(kinds != _OTHER, points, np.uint32(32)).tobytes().decode("utf-32-le").split()
    if (kinds == _JOINED).any():
        words = [w for w in words if w[0].isalpha() or any(map(str.isalpha, w))]
    return words


def _hashes(code_points: np.ndarray) -> np.ndarray:
    """Hash of each prefix of each row, the empty one first; a column for each row."""
    out = np.zeros((code_points.shape[1] + 1, len(code_points)), np.uint64)
    for k in range(code_points.shape[1]):
        out[k + 1] = out[k] * _BASE + code_points[:, k]
    return out


def _code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * _SLOT) >> np.uint64(64 - _SLOTS)


class Vocabulary:
    """The pieces made of small letters, with or without the mark; ids 0 .. n - 1, and n for a letter that is no piece by itself."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))}
        self.pieces = sorted(p for p in found if (s := p.removeprefix(MARK)) == s.lower() and (p == MARK or _LETTERS.fullmatch(s)))
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(self.pieces):
            by_length.setdefault(len(p), []).append(k)
        self.table = {}
        for n, ids in by_length.items():
            keys = _hashes(_code_points([self.pieces[k] for k in ids]))[-1]
            order = np.argsort(keys)
            slots = np.zeros(1 << _SLOTS, bool)  # most strings are no piece, which one look shows
            slots[_slot(keys)] = True
            self.table[n] = keys[order], np.array(ids)[order], slots

    def __len__(self) -> int:
        return len(self.pieces)

    def lattice(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length: end, start, which words have a piece there, and the pieces' ids, by ascending end."""
        prefix, n = _hashes(_code_points([MARK + w for w in words])), len(words[0]) + 1
        power = [np.uint64(1)]
        for _ in range(max(self.table, default=0)):
            power.append(power[-1] * _BASE)
        for end in range(1, n + 1):
            unknown = np.ones(len(words), bool)
            for size in sorted(self.table):
                if size > end:
                    break
                keys, ids, slots = self.table[size]
                wanted = prefix[end] - prefix[end - size] * power[size]
                hit = np.flatnonzero(slots[_slot(wanted)])
                if not len(hit):
                    continue
                at = np.minimum(np.searchsorted(keys, wanted[hit]), len(keys) - 1)
                right = keys[at] == wanted[hit]
                hit, at = hit[right], at[right]
                if size == 1:
                    unknown[hit] = False
                if len(hit):
                    yield end, end - size, hit, ids[at]
            if unknown.any():
                hit = np.flatnonzero(unknown)
                yield end, end - 1, hit, np.full(len(hit), len(self.pieces))


def vocabulary(path: str) -> Vocabulary:
    known = worker_memory("language pieces")
    if path not in known:
        with np.errstate(over="ignore"):
            known[path] = Vocabulary(path)
    return known[path]


def _by_length(words: list[str], width: int) -> Iterator[np.ndarray]:
    """Places of words of one length, so many that an array of ``width`` numbers for each of their letters stays bounded."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        step = max(1, CELLS // ((int(n) + 2) * width))
        for a in range(0, len(same), step):
            yield same[a:a + step]


def _summed(steps, size: int, shape: tuple[int, ...], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all ways from place 0 to each place, as numbers and the logarithms of their scales.

    ``steps`` are (to, from, which words, weights) by ascending ``to``, none longer than ``reach``.
    """
    value, scale = np.zeros((size + 1, *shape)), np.zeros((size + 1, *shape))
    value[0] = 1
    now, done = np.zeros(shape), 0
    for to, start, hit, weight in steps:
        if to > done:
            if done % RESCALE == 0 and done:
                window = slice(max(0, done + 1 - reach), done + 1)
                top = value[window].max(axis=0)
                value[window] /= top
                now = now + np.log(top)
                scale[window] = now
            done = to
            scale[to] = now
        value[to, hit] += value[start, hit] * weight
    return value, scale


def log_likelihood(vocab: Vocabulary, chances: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language (columns of ``chances``), summed over segmentations."""
    out = np.zeros((len(words), chances.shape[1]))
    for group in _by_length(words, chances.shape[1]):
        same = [words[k] for k in group]
        steps = ((end, start, hit, chances[ids]) for end, start, hit, ids in vocab.lattice(same))
        value, scale = _summed(steps, len(same[0]) + 1, (len(same), chances.shape[1]), max(vocab.table, default=1))
        out[group] = np.log(np.maximum(value[-1], 1e-300)) + scale[-1]
    return out


def expected_counts(vocab: Vocabulary, chances: np.ndarray, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, for one language."""
    total, reach = np.zeros(len(vocab) + 1), max(vocab.table, default=1)
    for group in _by_length(words, 2):
        same = [words[k] for k in group]
        size, steps = len(same[0]) + 1, list(vocab.lattice(same))
        forward, up = _summed(((end, start, hit, chances[ids]) for end, start, hit, ids in steps), size, (len(same),), reach)
        back = sorted(steps, key=lambda s: -s[1])  # the same ways from the other end
        backward, down = _summed(((size - start, size - end, hit, chances[ids]) for end, start, hit, ids in back), size, (len(same),), reach)
        whole = np.log(np.maximum(forward[-1], 1e-300)) + up[-1]
        for end, start, hit, ids in steps:
            share = forward[start, hit] * chances[ids] * backward[size - end, hit] * np.exp(up[start, hit] + down[size - end, hit] - whole[hit])
            total += np.bincount(ids, share * times[group][hit], minlength=len(total))
    return total


@dataclass
class Languages:
    names: list[str]
    prior: np.ndarray  # log share of the training documents
    chances: np.ndarray  # piece by language; the last row is a letter of no piece
    floor: np.ndarray | None = None  # least mean log probability a letter of texts in the language


class _Words:
    """Log probabilities of words by language, remembered."""

    def __init__(self, vocab: Vocabulary, chances: np.ndarray):
        self.vocab, self.chances = vocab, chances
        self.index: dict[str, int] = {}
        self.known = np.zeros((1 << 16, chances.shape[1]))

    def learn(self, split: list[list[str]]) -> None:
        if len(self.index) > WORDS_KEPT:
            self.index.clear()
        new, n = list({w for words in split for w in words} - self.index.keys()), len(self.index)
        while n + len(new) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        if new:
            with np.errstate(over="ignore"):
                self.known[n:n + len(new)] = log_likelihood(self.vocab, self.chances, new)
            self.index.update(zip(new, range(n, n + len(new))))

    def total(self, words: list[str]) -> np.ndarray:
        return self.known[[self.index[w] for w in words]].sum(axis=0)


def _letters(words: list[str]) -> int:
    """Letters of the words, with the marks in front."""
    return sum(map(len, words)) + len(words)


def fit(docs: DataFrame, path: str, rounds: int = ROUNDS) -> Languages:
    """Learn from all the documents given (the caller leaves out held-out rows).

    Rounds run over the distinct words of each language; the driver sees language counts and one number per piece and language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = usable.groupBy("lang").count().toPandas().sort_values("lang")
    names = counted["lang"].tolist()
    vocab_size = len(vocabulary(path)) + 1
    if not names:
        return Languages([], np.zeros(0), np.zeros((vocab_size, 0)))
    numbers = F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, k)))
    training = usable.select(numbers[F.col("lang")].alias("lang"), "text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}

        def flush() -> pa.RecordBatch:
            of = np.repeat(np.array(list(seen), np.int32), [len(c) for c in seen.values()])
            out = rows("lang int, word string, n long", of, list(chain.from_iterable(seen.values())),
                       np.fromiter(chain.from_iterable(c.values() for c in seen.values()), np.int64, len(of)))
            seen.clear()
            return out

        for batch in pieces(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text")):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > 500_000:
                yield flush()
        yield flush()
        released()

    words = stored(training.mapInArrow(count_words, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    chances = np.full((vocab_size, len(names)), 1.0 / vocab_size)
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(chances)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, total = vocabulary(path), np.zeros(shared.value.shape)
            with np.errstate(over="ignore"):
                for batch in batches:
                    langs, counts, texts = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1).to_pylist()
                    for lang in np.unique(langs):
                        own = np.flatnonzero(langs == lang)
                        total[:, lang] += expected_counts(vocab, shared.value[:, lang], [texts[k] for k in own], counts[own].astype(float))
            piece, lang = np.nonzero(total)
            yield rows("piece int, lang int, mass double", piece, lang, total[piece, lang])
            released()

        mass = (words.select("lang", "word", "n").mapInArrow(expect, "piece int, lang int, mass double")
                .groupBy("piece", "lang").agg(F.sum("mass").alias("mass")).toPandas())
        total = np.zeros_like(chances)
        total[mass["piece"], mass["lang"]] = mass["mass"]
        chances = _smoothed(total)
    return Languages(names, np.log(counted["count"].to_numpy(float) / counted["count"].sum()), chances, _floors(training, chances, path))


def _floors(training: DataFrame, chances: np.ndarray, path: str) -> np.ndarray:
    """Each language's floor, from the mean log probabilities a letter of its training documents, longer ones weighing more."""
    shared = training.sparkSession.sparkContext.broadcast(chances)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words(vocabulary(path), shared.value)
        for batch in pieces(batches, "text"):
            split = [words_of(t) for t in texts_of(batch, "text")]
            seen.learn(split)
            found = [(lang, seen.total(words)[lang] / n, n) for lang, words in zip(batch.column(0).to_pylist(), split) if (n := _letters(words))]
            yield rows("key int, value double, times long", *([x[k] for x in found] for k in range(3)))
        seen = None
        released()

    floor = np.full(chances.shape[1], -np.inf)  # a language without a letter has no text to be taken for it
    for lang, (middle, low) in quantiles(training.mapInArrow(fits, "key int, value double, times long"), [0.5, LOW]).items():
        floor[lang] = middle - np.clip(TIMES * (middle - low), -LEAST * middle, -MOST * middle)
    return floor


def _smoothed(mass: np.ndarray) -> np.ndarray:
    """Shares of each language's mass, mixed with a little of what all languages have in common and of chance."""
    own = mass / np.maximum(mass.sum(axis=0), 1e-9)
    common = own.mean(axis=1, keepdims=True)
    return 0.995 * own + 0.004 * common + 0.001 / len(mass)


def identify(docs: DataFrame, model: Languages, path: str, name: str = "language", fit: bool = False) -> DataFrame:
    """The documents with one more column: a struct of lang_pred and score, and of fit if asked for (0 or more: as good as
    the training documents let expect)."""
    # plain values: a broadcast object would need its class in every worker
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.prior, model.chances, model.floor))

    def build():
        model = Languages(*shared.value)
        seen = _Words(vocabulary(path), model.chances)

        def work(texts: list[bytes]) -> list:
            split = [words_of(t) for t in texts]
            if not model.names:
                split = [[] for _ in texts]
            seen.learn(split)
            best, score, over = [], [], []
            for words in split:
                if not words:
                    best.append("und")
                    score.append(0.0)
                    over.append(0.0)
                    continue
                own = seen.total(words)
                total = model.prior + own
                k = int(total.argmax())
                best.append(model.names[k])
                score.append(float(1 / np.exp(total - total[k]).sum()))
                over.append(float(own[k] / _letters(words) - (-np.inf if model.floor is None else model.floor[k])))
            return [best, score, over] if fit else [best, score]

        return work

    return docs.withColumn(name, text_function(build, PREDICTED + ", fit double" * fit)(F.col("text")))


def kept(docs: DataFrame, model: Languages, path: str) -> DataFrame:
    """The documents whose language is recognised with a score of ``KEEP_AT`` or more and that fit it, with their columns as they were."""
    name = next(f"language{k}" for k in range(len(docs.columns) + 1) if f"language{k}" not in docs.columns)
    return (identify(docs, model, path, name, fit=True)
            .where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= KEEP_AT) & (F.col(f"{name}.fit") >= 0)).select(*docs.columns))

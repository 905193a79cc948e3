"""Document quality: fixed base rules, then boosted trees over document statistics.

Words are runs of characters other than ASCII white space.  The base rules reject documents of fewer than 50 words and
those with more than half of their words in 3-word windows that the text repeats.  What passes is judged by boosted
trees fitted to all labelled rows; the score may only fall as the shares of symbols, capitals, repeated lines and
repeated words grow.

NULL and empty texts have all counts 0 and are rejected.  Repeated rows are judged alike, each for itself.  Extra
columns pass through ``judge`` untouched.  Several labels of one document count as their mean; labels that are NULL
or have no document are left out.  Without usable labels, whatever passes the base rules stays.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit_table
from .common import maybe_among, stored, text_function

KEEP_AT = 0.5
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# statistics the trees see, and how the score may move as each grows
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "capital_share": -1,
            "digit_share": 0, "mark_share": 0, "distinct_share": 0, "top_word_share": 0, "words_a_line": 0, "comma_share": 0}
_CAPITALS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    again = np.array([counts[w] > 1 for w in windows])
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(windows) + k] |= again
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text."""
    words = text.split()
    n = len(words)
    points = len(text.decode("utf-8", "replace"))
    chars = points - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    duplicates, repeats = len(lines) - len(set(lines)), repeated_words(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    share = lambda count: count / chars
    of_words = Counter(words)
    kinds = [len(text) - len(text.translate(None, x)) for x in (_CAPITALS, _DIGITS, b"!?", b",;")]
    return ([n, chars, symbols, duplicates, repeats],
            [np.log1p(n), chars / n, share(symbols), duplicates / len(lines), repeats / n, share(kinds[0]), share(kinds[1]), share(kinds[2]),
             len(of_words) / n, of_words.most_common(1)[0][1] / n, n / len(lines), share(kinds[3])])


STATISTICS = ", ".join(f"{x} long" for x in BASE) + ", " + ", ".join(f"{x} double" for x in FEATURES)
JUDGED = ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, kept boolean, score double"


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [statistics(t) for t in texts]
    return np.array([b for b, _ in both], np.int64).reshape(-1, len(BASE)), np.array([f for _, f in both], float).reshape(-1, len(FEATURES))


def statistics_of(text: str) -> Column:
    """A struct of base counts and features of a text column."""

    def build():
        def work(texts: list[bytes]) -> list:
            base, features = _counted(texts)
            return [*base.T, *features.T]
        return work

    return text_function(build, STATISTICS)(F.col(text))


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees for P(quality = 1), from all labelled documents that pass the base rules."""
    labelled = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("label")))
    seen = (maybe_among(docs.select("doc_id", "text"), labelled, "doc_id").select("doc_id", statistics_of("text").alias("s"))
            .join(labelled, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.max("s").alias("s"))
            .select("label", *(f"s.{x}" for x in FEATURES), "s.n_words", "s.n_repeat_words"))
    seen = stored(seen.where(~_base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("label", *FEATURES), "quality-labelled")
    return fit_table(seen, list(FEATURES), "label", np.array(list(FEATURES.values())))


def _base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judge(docs: DataFrame, trees: Trees, name: str = "quality") -> DataFrame:
    """The documents with one more column: a struct of base counts, base_failed, kept and score."""

    def build():
        def work(texts: list[bytes]) -> list:
            base, features = _counted(texts)
            failed, score = _base_failed(base[:, 0], base[:, 4]), trees.score(features)
            return [*base.T, failed, ~failed & (score >= KEEP_AT), score]
        return work

    return docs.withColumn(name, text_function(build, JUDGED)(F.col("text")))


def kept(docs: DataFrame, trees: Trees) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    name = next(f"quality{k}" for k in range(len(docs.columns) + 1) if f"quality{k}" not in docs.columns)
    return judge(docs, trees, name).where(F.col(f"{name}.kept")).select(*docs.columns)

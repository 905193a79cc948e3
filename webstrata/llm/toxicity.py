"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive examples, all other training documents are unlabelled text that may hide
more of them.  A linear classifier over the presence of words is trained in numpy on the class-prior-corrected risk
``prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])``; when the second part falls below zero the
step goes against it, so that the unlabelled positives are not memorised.

Words are runs of letters, lower-cased, over the whole text.  NULL and empty texts get the score of a text without any
known word.  Repeated rows count once each; several labels of one document count as toxic if one is.  NULL labels and
labels without a document are left out.  Without a positive example every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, pieces, rows, text_function, texts_of

POSITIVE_ROWS = 5_000  # confirmed toxic documents used for the fit
UNLABELLED_ROWS = 15_000  # unlabelled documents used for the fit, about
WORDS = 2_000  # words the classifier looks at
LEAST_Z = 4.0  # how clearly a word must be more frequent in toxic documents than in unlabelled ones
PREDICT_AT = 0.3
SCORED = "score double, predicted int"
_LETTERS = re.compile(r"[^\W\d_]+")


def word_set(text: bytes) -> set[str]:
    return set(_LETTERS.findall(text.decode("utf-8", "replace").lower()))


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def score(self, text: bytes) -> float:
        raw = self.bias + sum(self.weights[w] for w in word_set(text) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(raw, -35, 35))))


def fit_linear(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float,
               steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from the feature numbers present in each example; logistic loss, Adam, whole batches."""

    def flat(examples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(examples)), [len(e) for e in examples]), np.concatenate([*examples, np.zeros(0, np.int64)]).astype(np.int64)

    def gradient(part: tuple[np.ndarray, np.ndarray], slope: np.ndarray) -> np.ndarray:
        row, feature = part
        return np.append(np.bincount(feature, slope[row], size), slope.sum()) / len(slope)

    def value(part: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        return np.bincount(part[0], theta[part[1]], n) + theta[-1]

    parts, counts = (flat(positive), flat(unlabelled)), (len(positive), len(unlabelled))
    theta = np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        f_p, f_u = (value(p, n) for p, n in zip(parts, counts))
        s_p, s_u = (1 / (1 + np.exp(-np.clip(f, -35, 35))) for f in (f_p, f_u))
        negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        towards = gradient(parts[1], s_u) - prior * gradient(parts[0], s_p)
        g = prior * gradient(parts[0], s_p - 1) + towards if negative >= 0 else -towards
        g[:-1] += ridge * theta[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learn from the documents and labels given (the caller leaves out held-out rows).

    Positives are the ``POSITIVE_ROWS`` toxic ids with the smallest hashes; the unlabelled sample are the documents whose
    id hashes below a share set from their count.  The driver sees the ids of ``WORDS`` words in each sampled document.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = usable.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return Classifier({}, -35.0)
    prior = min(float(share), 0.5)
    chosen = usable.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVE_ROWS).select("doc_id", F.lit(True).alias("positive"))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    drawn = draw < min(1.0, UNLABELLED_ROWS / max(1, known.count()))
    sample = (known.join(F.broadcast(chosen), "doc_id", "left")  # at most POSITIVE_ROWS ids
              .select(F.coalesce("positive", F.lit(False)).alias("positive"), drawn.alias("drawn"), "text").where("positive OR drawn"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        n = [0, 0]
        for batch in pieces(batches, "text"):
            for positive, drawn, text in zip(column_of(batch, "positive").to_pylist(), column_of(batch, "drawn").to_pylist(), texts_of(batch, "text")):
                words = word_set(text)
                for kind, counts in enumerate((positive, drawn)):
                    if counts:
                        seen[kind].update(words)
                        n[kind] += 1
        words = list(seen[0].keys() | seen[1].keys())
        yield rows("word string, p long, u long", [None, *words], [n[0], *(seen[0][w] for w in words)], [n[1], *(seen[1][w] for w in words)])

    counted = (sample.mapInArrow(count_words, "word string, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u")))
    totals = counted.where("word IS NULL").first()
    if totals is None or not totals["p"]:
        return Classifier({}, -35.0)
    n_p, n_u = totals["p"], totals["u"]
    p, u = F.col("p") / n_p, F.col("u") / max(1, n_u)
    z = (p - u) / F.sqrt((p + u) / 2 * (1 - (p + u) / 2) * (1 / n_p + 1 / max(1, n_u)) + 1e-12)
    words = [r["word"] for r in counted.where("word IS NOT NULL AND p >= 3").withColumn("z", z).where(F.col("z") >= LEAST_Z)
             .orderBy(F.desc("z"), "word").limit(WORDS).collect()]
    number = {w: k for k, w in enumerate(words)}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [[number[w] for w in word_set(t) & number.keys()] for t in texts_of(batch, "text")]
            yield rows("positive boolean, drawn boolean, found array<int>", column_of(batch, "positive"), column_of(batch, "drawn"), found)

    examples = sample.mapInArrow(look_up, "positive boolean, drawn boolean, found array<int>").toPandas()
    of = lambda flag: [np.asarray(x, np.int64) for x in examples.loc[examples[flag], "found"]]
    weights, bias = fit_linear(of("positive"), of("drawn"), len(words), prior)
    return Classifier(dict(zip(words, weights.tolist())), bias)


def scored(text: Column, model: Classifier) -> Column:
    """A struct of score and predicted for a text column."""

    def build():
        def work(texts: list[bytes]) -> list:
            score = [model.score(t) for t in texts]
            return [score, [int(s >= PREDICT_AT) for s in score]]
        return work

    return text_function(build, SCORED)(text)

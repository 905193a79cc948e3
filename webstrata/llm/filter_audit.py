"""Filter interaction audit: what each filter removes, step by step, in every order of the filters.

Each document gets a mask of the filters that it fails.  Documents are counted by part and mask ("cells"); a recursive
query then extends prefixes of filters by unused letters, one letter a level, joined with the masks that occur, and emits
for each whether that step keeps, removes or would have removed its documents.  Weighting this by the cells gives the
metrics of all prefixes; an order of all filters is read off its prefixes.

The recursion sees masks, not documents or parts: for five filters it has at most 325 prefixes times 32 masks however
large the corpus is.  The documents are read once; only digests and masks are shuffled, by digest and by id.

NULL texts are empty, NULL parts are the empty string.  The duplicate filter compares ids: a document without an id has
no smaller one and is nobody's smaller one; rows that repeat an id and a text stand or fall together.  A document with
several rows in ``labels`` is good or toxic if one of them says so; labels without a document are left out.  An empty
table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_function

LETTERS = "ABCDE"  # few words, few distinct words, capitals, symbols, duplicate text
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = b"#$%&*|"
DUPLICATE = 1 << LETTERS.index("E")
_CAPITALS = bytes(range(65, 91))

WALK = """
WITH RECURSIVE walk(prefix, applied, step, mask, kept, removed, redundant, sole) AS (
  SELECT '', 0, 0, mask, 1, 0, 0, 0 FROM {masks}
  UNION ALL
  SELECT concat(w.prefix, f.letter), w.applied | f.bit, w.step + 1, w.mask,
         CAST((w.applied | f.bit) & w.mask = 0 AS INT),
         CAST(w.applied & w.mask = 0 AND f.fails AS INT),
         CAST(w.applied & w.mask <> 0 AND f.fails AS INT),
         CAST(w.mask = f.bit AS INT)
  FROM walk w JOIN {failures} f ON f.mask = w.mask AND w.applied & f.bit = 0)
SELECT * FROM walk WHERE step > 0
"""


def failed(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    n = len(words)
    points = len(text.decode("utf-8", "replace"))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (n < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * points,
             any(symbol in text for symbol in SYMBOLS))
    return sum(fail << k for k, fail in enumerate(fails))


def text_mask(text: Column) -> Column:
    def build():
        return lambda texts: [[failed(t) for t in texts]]

    return text_function(build, "mask int")(text)["mask"]


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly the filters of a mask."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                              F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask")), "filter-masks")
    known = seen.where("doc_id IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic")))))
    judged = (known.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
              .select("part", (F.col("mask") + F.when(F.col("first").isNull(), DUPLICATE).otherwise(0)).alias("mask"), "good", "toxic"))
    without_id = seen.where("doc_id IS NULL").select("part", "mask", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return (judged.union(without_id).groupBy("part", "mask")
            .agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic"))))


def walked(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per prefix of filters and mask that occurs: the step, and what it does to documents of that mask."""
    spark = counted.sparkSession
    masks = counted.select("mask").distinct()
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("letter"), F.lit(1 << k).alias("bit")) for k, x in enumerate(letters))))
    failures = masks.select("mask", each.alias("f")).select("mask", "f.letter", "f.bit", (F.col("mask").bitwiseAND(F.col("f.bit")) != 0).alias("fails"))
    return spark.sql(WALK, masks=masks, failures=failures)


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """All metrics of every part, order of filters and step."""
    counted = stored(counted, "filter-cells")
    walk = stored(walked(counted, letters), "filter-prefixes")
    metric = lambda flag, count, name: F.sum(F.col(flag) * F.col(count)).alias(name)
    steps = stored(walk.join(counted, "mask").groupBy("part", "prefix", "step")
                   .agg(metric("kept", "n", "kept"), metric("removed", "n", "removed"), metric("redundant", "n", "redundant"), metric("sole", "n", "unique_fails"),
                        metric("removed", "good", "good_lost"), metric("removed", "toxic", "toxic_lost")), "filter-steps")
    last = F.substring("prefix", -1, 1)
    # a prefix of s letters begins (number of filters - s)! orders
    shares = steps.groupBy("part", last.alias("letter")).agg(F.sum(F.col("removed") * F.factorial(F.lit(len(letters)) - F.col("step"))).alias("shapley"))
    orders = (walk.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
              .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))).withColumn("prefix", F.expr("substring(filter_order, 1, step)")))
    return (orders.join(steps.withColumn("letter", last), ["prefix", "step"]).join(shares, ["part", "letter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    return audit(cells(docs, labels, part))

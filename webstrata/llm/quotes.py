"""Quoted passages linked to the messages they come from, and conversations in reply order without the quotes.

A line's quote level is the number of ``>`` at its beginning.  Runs of lines of one level without a blank one are
passages.  A quoted passage, and each line of ``LEAST_CHARS`` characters or more inside a longer one, is looked up by the
hash of its normalised form (small letters, single spaces) among the own texts of the conversation: whole messages,
their passages and all their lines, however short.  The original is the first message that says it, and counts if its turn is earlier.  A message
replies to the original of its outermost linked quotes, the one it quotes most of (ties: the later turn).

Threads begin with messages that reply to nothing; a conversation is ordered by the first turns of its threads, then by
turn, so that every message comes after the one it answers.  ``position`` counts from 0.  Own text is what is left
without quoted lines and the attribution lines above them.

NULL and empty texts have an empty own text.  Rows with a NULL conversation or turn are never linked; NULL sorts first,
and rows of one conversation and turn are ordered by role and text.  Repeated rows all stay.  Columns other than the four
are ignored; an empty table gives no rows.  All steps are column functions, joins and aggregations: a conversation is
never gathered in one task, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tasks_for

LEAST_CHARS = 16
ROWS_A_TASK = 200_000
_MARKS = r"^(?:[ \t]*>)+"
_ATTRIBUTION = r"(?i)(?:wrote|schrieb|escribió|a écrit)[ \t]*:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f]+", " "))


def _lines(text: Column) -> Column:
    """Level and content of each line; an attribution line right above a quote has level -1."""
    raw = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", ""))
    pairs = F.zip_with(raw, F.slice(F.concat(raw, F.array(F.lit(""))), F.lit(2), F.size(raw)), lambda x, after: F.struct(
        F.when((level(x) == 0) & (level(after) > 0) & x.rlike(_ATTRIBUTION), F.lit(-1)).otherwise(level(x)).alias("level"),
        F.regexp_replace(x, _MARKS + r"[ \t]?", "").alias("content")))
    return pairs


def parsed(messages: DataFrame) -> DataFrame:
    """The messages with ``own`` text and ``passages``: level and lines of each run of lines of one level, blank ones left out.

    Every array is a column of its own before it is looked into, so that no function computes it anew for each element.
    """
    base = ["conv_id", "turn", "role", "text"]
    kind = lambda x: F.when(F.trim(x.content) == "", F.lit(-2)).otherwise(x.level)
    lines = messages.select(*base, _lines(F.col("text").cast("string")).alias("lines"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.content), "\n")
    kinds = lines.select(*base, "lines", F.regexp_replace(own, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "").alias("own"), F.transform("lines", kind).alias("kinds"))
    starts = kinds.select("*", F.filter(F.sequence(F.lit(1), F.size("kinds")),
                                        lambda k: (k == 1) | (F.element_at("kinds", k) != F.element_at("kinds", F.greatest(k - 1, F.lit(1))))).alias("starts"))
    ends = starts.select("*", F.slice(F.concat("starts", F.array(F.size("lines") + 1)), F.lit(2), F.size("starts")).alias("ends"))
    runs = F.zip_with("starts", "ends", lambda a, b: F.struct(F.element_at("kinds", a).alias("level"),
                                                              F.transform(F.slice("lines", a, b - a), lambda x: x.content).alias("lines")))
    return ends.select(*base, "own", F.filter(runs, lambda r: r.level >= 0).alias("passages"))


def _units(passages: Column) -> Column:
    """Level, passage number and normalised form of each passage and of its lines, of quoted ones of the longer lines."""
    def of(p: Column, number: Column) -> Column:
        forms = F.concat(F.array(normalised(F.array_join(p.lines, " "))),
                         F.filter(F.transform(p.lines, normalised), lambda x: (p.level == 0) | (F.length(x) >= LEAST_CHARS)))
        return F.transform(F.array_distinct(forms), lambda x: F.struct(p.level.alias("level"), number.alias("number"), x.alias("form")))
    return F.flatten(F.transform(passages, of))


def reply_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to and n_linked (linked quoted passages) of the messages that quote an earlier one."""
    known = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    # outer: an inner explode is preceded by a test of the array, for which everything below would be computed once more
    said = known.select("conv_id", "turn", F.explode_outer(F.array_distinct(F.concat(
        F.transform(F.filter(_units(F.col("passages")), lambda u: u.level == 0), lambda u: u.form), F.array(normalised(F.col("own")))))).alias("form"))
    key = lambda: (F.xxhash64("form").alias("h"), F.length("form").alias("chars"))
    first = said.where("form <> ''").select("conv_id", "turn", *key()).groupBy("conv_id", "h", "chars").agg(F.min("turn").alias("original"))
    quoted = (known.where(F.col("text").rlike(r"(^|\n)[ \t]*>")).select("conv_id", "turn", F.explode_outer(_units(F.col("passages"))).alias("u"))
              .where("u.level > 0").select("conv_id", "turn", "u.level", "u.number", "u.form").select("conv_id", "turn", "level", "number", *key()))
    linked = quoted.join(stored(first, "quote-originals"), ["conv_id", "h", "chars"]).where("original < turn")
    weights = (linked.groupBy("conv_id", "turn", "level", "original", "number").agg(F.max("chars").alias("chars"))
               .groupBy("conv_id", "turn", "level", "original").agg(F.sum("chars").alias("chars"), F.count("*").alias("n")))
    return weights.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("chars"), F.col("original"))).getField("original").alias("reply_to"),
                                                  F.sum("n").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """The links with ``thread``, the first turn of the thread, and ``depth``: pointers double their reach each round."""
    found = stored(links.select("*", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "quote-threads")
    while True:
        ahead = found.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        moved = found.join(ahead, ["conv_id", "thread"], "left")
        if moved.where("further IS NOT NULL").isEmpty():
            return found
        found = stored(moved.select(*links.columns, F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
                       "quote-threads")


def conversations_in_reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own), position, thread, reply_to, depth, n_quotes and n_linked of every row."""
    spark = messages.sparkSession
    read = parsed(messages)
    placed = threads(reply_links(read))
    quotes = F.size(F.filter("passages", lambda p: p.level > 0)).cast("long")
    rows = (read.select("conv_id", "turn", "role", F.col("own").alias("text"), quotes.alias("n_quotes"), F.md5(F.col("text").cast("string")).alias("_tie"))
            .join(placed, ["conv_id", "turn"], "left"))
    rows = rows.select("conv_id", "turn", "role", "text", F.coalesce("thread", "turn").alias("thread"), "reply_to", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
                       "n_quotes", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "_tie")
    # ranks without gathering a conversation: sorted ranges, then the ranges' sizes (one row each) and each conversation's first rank
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "thread", "turn", "role", "_tie")]
    ranges = tasks_for(spark, messages.count(), ROWS_A_TASK)
    ranked = stored(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "quote-order")
    ranked = ranked.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = ranked.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    ranked = ranked.join(F.broadcast(before), "_range").withColumn("_rank", F.col("_at") + F.col("_before"))
    first = stored(ranked.groupBy("conv_id").agg(F.min("_rank").alias("_first")), "quote-first").withColumnRenamed("conv_id", "_conv")
    return (ranked.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")))
            .select("conv_id", "turn", "role", "text", (F.col("_rank") - F.col("_first")).alias("position"), "thread", "reply_to", "depth", "n_quotes", "n_linked"))

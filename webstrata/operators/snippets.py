"""Excerpts around search terms, places to highlight."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .dom import page_components
from .query import Query, search

# the texts of a resource, the most telling first
PARTS = ["url", "text", "attributes", "comments", "headers", "markup"]
WORDS_AROUND = 8
_LETTER = r"[\p{L}\p{N}_]"
# stand around a term while a text is cut up; no characters of any text
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"

# --- fixed value: how a marked term looks in stored excerpts
MARKER = r"\*\*([^*]+)\*\*"
# --- end of fixed value


def term_pattern(terms: list[str]) -> str:
    """Any of the terms as whole words, whatever the case; of terms that begin alike the longer one."""
    words = "|".join(re.escape(t).replace(r"\ ", " ") for t in sorted(terms, key=len, reverse=True))
    return rf"(?iu)(?<!{_LETTER})({words})(?!{_LETTER})"


def _found(texts: DataFrame, terms: list[str], around: int) -> DataFrame:
    """``texts`` with an array column ``excerpts`` of (word, excerpt) for its column ``text``; NULL where no term is found.

    A text is its words.  Words where a term begins, no further apart than twice ``around``, share an
    excerpt, which reaches ``around`` words beyond the first and the last of them.  The terms are marked in the whole
    text at once, so a word tells by its mark whether a term begins in it.  Every array is a column of its own before it is
    looked into, so the work grows with the length of the text.
    """
    pattern, longest = term_pattern(terms), max(len(t.split()) for t in terms)
    clean = F.translate("text", _OPEN + _CLOSE, "")
    marked = F.when(F.col("text").rlike(pattern), F.split(F.regexp_replace(clean, pattern, f"{_OPEN}$1{_CLOSE}"), " "))
    split = texts.withColumn("w", marked)
    places = F.transform("w", lambda word, i: F.when(F.contains(word, F.lit(_OPEN)), i + 1))
    # no filter on what is computed here: it would be computed anew inside the filter, array by array
    hits = split.withColumn("hits", F.filter(places, lambda i: i.isNotNull())).withColumn("i", F.when(F.size("hits") > 0, F.sequence(F.lit(1), F.size("hits"))))
    firsts = hits.withColumn("firsts", F.filter("i", lambda k: (k == 1) | (
        F.element_at("hits", k) - F.element_at("hits", F.greatest(k - 1, F.lit(1))) > 2 * around)))
    lasts = firsts.withColumn("lasts", F.concat(F.transform(F.slice("firsts", F.lit(2), F.size("firsts") - 1), lambda k: k - 1), F.array(F.size("hits"))))

    def excerpt(a: Column, b: Column) -> Column:
        low = F.greatest(F.element_at("hits", a) - around, F.lit(1))
        words = F.slice("w", low, F.element_at("hits", b) + longest + around - low)
        return F.struct(F.element_at("hits", a).alias("word"), F.regexp_replace(F.array_join(words, " "), f"[{_OPEN}{_CLOSE}]", r"**").alias("excerpt"))

    return lasts.withColumn("excerpts", F.zip_with("firsts", "lasts", excerpt)).drop("w", "hits", "i", "firsts", "lasts")


def excerpts(resources: DataFrame, query: Query, site_ids: list[int] | None = None, around: int = WORDS_AROUND) -> DataFrame:
    """One row per excerpt of every hit: (site, id, url, part, word, excerpt), terms marked with ``**``.

    ``part`` names the text, ``word`` counts the words of that text up to the first term, from 1.
    """
    terms = list(dict.fromkeys(query.terms()))
    parts = page_components(search(resources, query, site_ids))
    texts = parts.select("site", "id", "url", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), tx.squash(F.col(p)).alias("text")) for p in PARTS])).alias("t"))
    if not terms:
        return texts.select("site", "id", "url", "t.part", F.lit(0).alias("word"), F.lit("").alias("excerpt")).limit(0)
    found = _found(texts.select("site", "id", "url", "t.part", "t.text"), terms, around)
    # an inner explode would be preceded by a test of the array, which would be built once more for it
    rows = found.select("site", "id", "url", "part", F.explode_outer("excerpts").alias("e")).where(F.col("e").isNotNull())
    return rows.select("site", "id", "url", "part", "e.*")


def snippets(resources: DataFrame, query: Query, site_ids: list[int] | None = None, shown: int = 3, around: int = WORDS_AROUND) -> DataFrame:
    """(site, id, url, snippet) of every hit: the first ``shown`` excerpts and how many more there are.

    The parts of a hit are read one after the other within its row; NULL where none holds a term.
    """
    terms = list(dict.fromkeys(query.terms()))
    hits = page_components(search(resources, query, site_ids))
    if not terms:
        return hits.select("site", "id", "url", F.lit(None).cast("string").alias("snippet"))
    # parts are joined by more empty words than an excerpt reaches over, so that none spans two parts
    gap = " " * (4 * around + 2)
    whole = F.array_join(F.array(*[tx.squash(F.coalesce(F.col(p), F.lit(""))) for p in PARTS]), gap)
    found = _found(hits.select("site", "id", "url", whole.alias("text")), terms, around)
    e = found.withColumn("e", F.transform("excerpts", lambda e: F.trim(e["excerpt"])))
    text = F.array_join(F.slice("e", 1, shown), " ... ")
    more = F.size("e") - shown
    return e.select("site", "id", "url", F.when(more > 0, F.concat(text, F.lit(" ... +"), more.cast("string"), F.lit(" more"))).otherwise(text).alias("snippet"))


def highlight_spans(df: DataFrame, column: str, terms: list[str], keys: list[str]) -> DataFrame:
    """(keys..., start, stop, text) of the places to highlight.

    Every term is found by itself, so terms may overlap; what overlaps becomes one place.  All of it happens within the
    row: the pieces between the matches of a term and the matches are laid end to end, offsets are running sums of
    their lengths, and places that begin before the furthest end so far are joined.
    """
    wanted = list(dict.fromkeys(t.lower() for t in terms if t.strip()))
    if not wanted:
        return df.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("text")).limit(0)

    rows = df.where(F.col(column).rlike(term_pattern(wanted))).select(*keys, F.col(column).alias("_text"))
    for n, term in enumerate(wanted):
        pattern = term_pattern([term])
        rows = (rows.withColumn("_m", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
                .withColumn("_ends", F.zip_with(F.slice(F.split("_text", pattern, -1), F.lit(1), F.size("_m")), "_m", lambda p, m: F.length(p) + F.length(m)))
                .withColumn("_ends", tx.running("_ends", lambda a, b: a + b))
                .withColumn(f"_s{n}", F.zip_with("_ends", "_m", lambda stop, m: F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("text")))))
    merged = (rows.withColumn("_s", F.array_sort(F.concat(*[f"_s{n}" for n in range(len(wanted))])))
              .withColumn("_far", tx.running(F.transform("_s", lambda s: s["stop"]), F.greatest))
              .withColumn("_i", F.sequence(F.lit(1), F.size("_s")))
              .withColumn("_first", F.filter("_i", lambda i: (i == 1) | (F.element_at("_s", i)["start"] >= F.element_at("_far", F.greatest(i - 1, F.lit(1))))))
              .withColumn("_last", F.concat(F.transform(F.slice("_first", F.lit(2), F.size("_first") - 1), lambda k: k - 1), F.array(F.size("_s")))))

    def place(a: Column, b: Column) -> Column:
        first, stop = F.element_at("_s", a), F.element_at("_far", b)
        # a place of one match is that match; only joined ones are cut out of the text
        text = F.when(first["stop"] == stop, first["text"]).otherwise(F.substring("_text", first["start"] + 1, stop - first["start"]))
        return F.struct(first["start"].alias("start"), stop.alias("stop"), text.alias("text"))

    return merged.select(*keys, F.explode(F.zip_with("_first", "_last", place)).alias("p")).select(*keys, "p.*")


def strip_markers(snippet: Column) -> Column:
    """Snippet without its bold marks."""
    return F.trim(F.regexp_replace(tx.squash(snippet), MARKER, "$1"))


def marked_spans(snippet: Column) -> Column:
    """Where the marked words are in the text that ``strip_markers`` returns.

    The pieces between the marks and the marked words are laid end to end; snippets are short.
    """
    line = tx.squash(snippet)
    pieces = F.split(line, MARKER, -1)
    words = F.regexp_extract_all(line, F.lit(MARKER), F.lit(1))
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(words)).alias("piece"), words.alias("word"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["piece"])
        stop = begin + F.length(pair["word"])
        added = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.concat(acc["found"], added).alias("found"))

    return F.aggregate(pairs, start, step, lambda acc: acc["found"])

"""A stored index: word-pair postings that grow by segments and answer saved queries in one pass.

An index is a folder.  ``append`` adds a segment: the narrow columns of its resources, one posting per token occurrence
with the token that follows it, and a sorted vocabulary.  Resources are dealt into tasks of bounded text; the postings of a
task and field are a run of their own, sorted by (token, next), so they never travel, and all that is known of a
field of a resource stands in one run.  A token is a range of each run, a pair of tokens a narrower one; Parquet statistics skip the
rest.  A resource appended again replaces its earlier capture, whichever segments they are in; ``merge`` writes what is current as
one segment of a new generation, run by run without sorting or moving it, and takes what was replaced off the counts.  A segment counts once its number stands in the table ``commits``, so a write that fails
half-way changes nothing and its leftovers are overwritten.  One writer at a time; readers see whole segments only.

A search reads the postings of the words that its queries need, reduces them to a few bits per row where they are read, and
joins these with the narrow rows: one exchange by row on either side, of about one row for each resource that is met.  Phrases are looked up pair by pair, so frequent
words travel only where they stand together; the pairs of longer phrases are counted by place.  Stems are looked up in
the vocabulary and become tokens.

Rows without a site or an id cannot be found.  Within one ``append`` a (site, id) is one resource: pass the newest captures.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import saved
from .groups import cut, spread
from .query import TEXT_FIELDS, Query

KEY = ["site", "id"]
NARROW = {"url": "string", "type": "string", "status": "int", "size": "long", "time": "int"}
POSTING = ["token", "next", *KEY, "pos"]
TASK_BYTES = 16 << 20  # text whose postings one task sorts, about
LEAST_BYTES = 1 << 20  # text that is worth a task of its own
ROW_GROUP = 16 << 20  # of postings; its statistics are what a search skips by
SENT = 2 << 20  # replaced resources that are sent to every task, at most
SCHEMAS = {"rows": "site long, id long, " + ", ".join(f"{n} {t}" for n, t in NARROW.items()) + ", segment int",
           "postings": "token string, next string, site long, id long, pos int, segment int, field string",
           "vocabulary": "field string, token string, df long, cf long, segment int"}
_ELEMENTS = pa.schema([("literal", pa.int32()), ("parts", pa.int32()), ("k", pa.int32()), ("field", pa.string()), ("token", pa.string()),
                       ("next", pa.string()), ("stem", pa.bool_())])


def occurrences(resources: DataFrame, fields: Iterable[str] = TEXT_FIELDS) -> DataFrame:
    """(field, token, next, site, id, pos): every token of every indexed field with its successor, '' at the end; no shuffle."""
    fields = tuple(fields)
    return _occurrences(spread(resources.select(*dict.fromkeys([*KEY, *fields]))).where(F.col("site").isNotNull() & F.col("id").isNotNull()), fields)


def _words(own: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    each = own.select(*KEY, F.explode(texts).alias("t"))
    return each.select(*KEY, "t.field", tx.tokens(F.col("t.text")).alias("w"))


def _occurrences(own: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    pairs = _words(own, fields).select(*KEY, "field", F.posexplode(F.arrays_zip(F.col("w").alias("token"), F.slice("w", F.lit(2), F.size("w")).alias("next"))).alias("pos", "z"))
    return pairs.select("field", "z.token", F.coalesce("z.next", F.lit("")).alias("next"), *KEY, "pos")


def _sizes(resources: DataFrame, fields: tuple[str, ...]) -> dict[str, int]:
    """Bytes of text by field."""
    size = resources.agg(*[F.sum(F.octet_length(F.col(f).cast("string")).cast("long")).alias(f"s{n}") for n, f in enumerate(fields)], F.lit(0)).first()
    return {f: size[n] or 0 for n, f in enumerate(fields)}


def _tasks(sizes: list[int], spark: SparkSession) -> int:
    """As many tasks as bounded texts need; a smaller input is spread over the cores."""
    size, cores = sum(sizes), spark.sparkContext.defaultParallelism
    return max(1, min(cores, -(-size // LEAST_BYTES)), -(-size // TASK_BYTES))


def _counted(by_row) -> DataFrame:
    """field, token, df, cf of postings grouped by field, token and row."""
    return by_row.agg(F.count("*").alias("tf")).groupBy("field", "token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    # ---- what is stored

    def committed(self) -> tuple[int, list[int]]:
        """The current generation and its segments; one row per append ever made is read for it."""
        try:
            rows = self.spark.read.schema("generation int, segment int").parquet(f"{self.path}/commits").collect()
        except AnalysisException:
            return 0, []
        newest = max(r.generation for r in rows)
        return newest, sorted(r.segment for r in rows if r.generation == newest)

    def view(self) -> "View":
        """What is committed now, for any number of searches."""
        generation, segments = self.committed()
        if not segments:
            raise ValueError(f"nothing is indexed in {self.path}")
        return View(self.spark, f"{self.path}/generation={generation}", tuple(segments))

    def search(self, queries: dict[str, Query]) -> DataFrame:
        return self.view().search(queries)

    # ---- writing

    def _at(self, generation: int, segment: int, name: str) -> str:
        return f"{self.path}/generation={generation}/{name}/segment={segment}"

    def _commit(self, generation: int, segment: int, rows: DataFrame, vocabulary: DataFrame) -> None:
        """Rows and vocabulary beside postings that are written; the segment counts from here on."""
        rows.select(*KEY, *[F.col(n).cast(t).alias(n) for n, t in NARROW.items()]).write.mode("overwrite").parquet(self._at(generation, segment, "rows"))
        (vocabulary.repartitionByRange("field", "token").sortWithinPartitions("field", "token")
         .write.mode("overwrite").parquet(self._at(generation, segment, "vocabulary")))
        self.spark.createDataFrame([(generation, segment)], "generation int, segment int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _postings(self, generation: int, segment: int) -> Callable[[str, DataFrame], None]:
        """What writes the postings of a field; what a failed write left is cleared first."""
        at = self._at(generation, segment, "postings")
        self.spark.createDataFrame([], SCHEMAS["postings"].replace(", segment int", "")).write.mode("overwrite").partitionBy("field").parquet(at)
        return lambda name, postings: postings.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{at}/field={name}")

    def append(self, resources: DataFrame, fields: Iterable[str] = TEXT_FIELDS) -> "Index":
        """One more segment; its resources replace earlier captures of theirs."""
        generation, segments = self.committed()
        segment, fields = max(segments, default=-1) + 1, tuple(fields)
        known = resources.where(F.col("site").isNotNull() & F.col("id").isNotNull())
        # all rows of a resource meet in one task, which counts and sorts alone
        dealt = lambda *names: known.select(*dict.fromkeys([*KEY, *names])).repartition(_tasks([sizes[n] for n in names], self.spark), *KEY)
        sizes, write = _sizes(known, fields), self._postings(generation, segment)
        for name in fields:
            write(name, _occurrences(dealt(name), (name,)).select(*POSTING).sortWithinPartitions("token", "next"))
        tokens = _words(dealt(*fields), fields).select(*KEY, "field", F.explode("w").alias("token"))
        self._commit(generation, segment, known, _counted(tokens.groupBy("field", "token", *KEY)))
        return self

    def merge(self) -> "Index":
        """What is current, as the only segment of the next generation; earlier generations are left to their owner."""
        generation, segments = self.committed()
        if len(segments) > 1:
            now, place = self.view(), [*KEY, "segment"]
            held = now.rows.groupBy(*KEY).agg(F.collect_set("segment").alias("s"))
            replaced = cut(held.where(F.size("s") > 1).select(*KEY, F.explode(F.filter("s", lambda x: x < F.array_max("s"))).alias("segment")))
            few = replaced.count() <= SENT
            gone = F.broadcast(replaced) if few else replaced
            # a field at a time, as it is read: runs stay sorted, unless so much is replaced that postings meet it in a shuffle
            write = self._postings(generation + 1, 0)
            for name in sorted(r.field for r in now.vocabulary.select("field").distinct().collect()):
                kept = now.postings.where(F.col("field") == name).join(gone, place, "left_anti").select(*POSTING)
                write(name, kept if few else kept.sortWithinPartitions("token", "next"))
            stale = _counted(now.postings.join(gone, place, "left_semi").groupBy("field", "token", *place))
            counts = now.vocabulary.select("field", "token", "df", "cf").union(stale.select("field", "token", -F.col("df"), -F.col("cf")))
            current = counts.groupBy("field", "token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
            self._commit(generation + 1, 0, now.rows.join(gone, place, "left_anti"), current)
        return self


@dataclass(frozen=True)
class View:
    """The segments of one generation that were committed at some moment."""

    spark: SparkSession
    path: str
    segments: tuple[int, ...]

    def _read(self, name: str) -> DataFrame:
        base = f"{self.path}/{name}"
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", base).parquet(*[f"{base}/segment={s}" for s in self.segments])

    @property
    def rows(self) -> DataFrame:
        return self._read("rows")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings")

    @property
    def vocabulary(self) -> DataFrame:
        return self._read("vocabulary")

    def terms(self) -> DataFrame:
        """field, token, df, cf, over the segments as they are: exact once they are merged."""
        return self.vocabulary.groupBy("field", "token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def hits(self, programs: saved.Programs) -> DataFrame:
        """(literal, parts, k, field, site, id, segment, pos): the postings that speak for a literal.

        ``parts`` is the number of pairs of a phrase, of which this is the one that begins ``k`` tokens behind the first.
        """
        wanted = [e for literal, n in programs.texts.items() for e in _elements(literal, n)]
        whole = [e for e in wanted if not (e[6] and e[5] is None)]
        stems = [e for e in wanted if e[6] and e[5] is None]
        found = []
        if whole:
            found.append(self._matching(self.postings.where(_pushed(whole)), self._table(whole)))
        if stems:
            starts = sorted({e[4] for e in stems})
            begins = functools.reduce(operator.or_, (F.col("token").startswith(s) for s in starts))
            lengths = F.array(*[F.lit(n) for n in sorted({len(s) for s in starts})])
            probes = (self.vocabulary.where(begins).select("field", "token").distinct().withColumn("n", F.explode(lengths))
                      .select("field", F.col("token").alias("whole"), F.expr("substring(token, 1, n)").alias("token")).distinct())
            tokens = probes.join(self._table(stems), ["field", "token"])
            tokens = tokens.select("literal", "parts", "k", "field", F.col("whole").alias("token"), "next", F.lit(False).alias("stem"))
            found.append(self._matching(self.postings.where(begins), tokens))
        if not found:  # terms without a token
            return self.postings.where(F.lit(False)).select(F.lit(0).alias("literal"), F.lit(1).alias("parts"), F.lit(0).alias("k"), "field", *KEY, "segment", "pos")
        return functools.reduce(DataFrame.unionByName, found)

    def _table(self, elements: list[tuple]) -> DataFrame:
        """As a local table, whose size the planner knows."""
        return self.spark.createDataFrame(pa.Table.from_pylist([dict(zip(_ELEMENTS.names, e)) for e in elements], _ELEMENTS))

    @staticmethod
    def _matching(postings: DataFrame, elements: DataFrame) -> DataFrame:
        e = elements.select("literal", "parts", "k", "field", "token", F.col("next").alias("probe"), "stem")
        follows = F.col("probe").isNull() | (F.col("next") == F.col("probe")) | (F.col("stem") & F.startswith("next", "probe"))
        return postings.join(e, ["field", "token"]).where(follows).select("literal", "parts", "k", "field", *KEY, "segment", "pos")

    def search(self, queries: dict[str, Query]) -> DataFrame:
        """(query_id, site, id) for every saved query and every current resource that satisfies it."""
        programs = saved.compiled(queries)
        place, words = [*KEY, "segment"], [f"w{w}" for w in range(programs.words)]
        rows = self.rows
        if len(self.segments) > 1:
            rows = rows.groupBy(*KEY).agg(F.max_by(F.struct("segment", *NARROW), "segment").alias("r")).select(*KEY, "r.*")
        if programs.texts:
            hits = self.hits(programs)
            found = hits.where("parts = 1").select(*place, "literal")
            if any(len(t.words) > 2 for t in programs.texts):
                start = (F.col("pos") - F.col("k")).alias("start")
                whole = hits.where("parts > 1").groupBy(*place, "literal", "parts", "field", start).agg(F.count("*").alias("seen")).where("seen = parts")
                found = found.union(whole.select(*place, "literal"))
            held = found.groupBy(*place).agg(*[F.bit_or(saved.bit(F.col("literal"), n)).alias(w) for n, w in enumerate(words)])
            # only queries that can be true without any text need the rows that hold none
            rows = rows.join(held, place, "left" if any(possible for *_, possible in programs.queries) else "inner")
        else:
            rows = rows.withColumns({w: F.lit(0).cast("long") for w in words})
        bits = F.array(*[F.coalesce(w, F.lit(0).cast("long")) for w in words])
        return rows.withColumn("bits", bits).select(F.explode(saved.answered(programs, F.col("bits"))).alias("query_id"), *KEY)


def _elements(literal, number: int) -> list[tuple]:
    """What to look up for a text literal: a token, or pairs of tokens that cover the phrase."""
    words, n = literal.words, len(literal.words)
    if not n:
        return []
    starts = [0] if n < 3 else [*range(0, n - 1, 2), *([n - 2] if n % 2 else [])]
    pairs = [(number, len(starts), k, words[k], words[k + 1] if n > 1 else None, literal.prefix and k + 2 >= n) for k in starts]
    return [(number, parts, k, name, token, following, stem) for number, parts, k, token, following, stem in pairs for name in literal.possible_fields]


def _pushed(elements: list[tuple]) -> Column:
    """A filter that the scan understands: fields, tokens, and for pairs the tokens that follow."""
    alone, pairs = [e for e in elements if e[5] is None], [e for e in elements if e[5] is not None]
    tests = []
    if alone:
        tests.append(F.col("token").isin(sorted({e[4] for e in alone})))
    if pairs:
        follows = [F.col("next").isin(sorted({e[5] for e in pairs if not e[6]}))] if any(not e[6] for e in pairs) else []
        follows += [F.col("next").startswith(s) for s in sorted({e[5] for e in pairs if e[6]})]
        tests.append(F.col("token").isin(sorted({e[4] for e in pairs})) & functools.reduce(operator.or_, follows))
    return F.col("field").isin(sorted({e[3] for e in elements})) & functools.reduce(operator.or_, tests)

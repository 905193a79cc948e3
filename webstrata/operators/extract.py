"""Regular-expression extraction over whole resources, and the rules for per-row extras."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import spread

# --- fixed values: pattern shapes that risk catastrophic backtracking
HAZARDS = [
    r"\([^)]*\*[^)]*\+", r"\([^)]*\+[^)]*\*", r"\([^)]*\+[^)]*\+", r"\([^)]*\*[^)]*\*",
    r"\.\*.*\.\*", r"\.\+.*\.\+", r"\([^)]*\?\)\*", r"\([^)]*\?\)\+",
    r"\([^)]*[*+?][^)]*[*+?][^)]*\)[*+]",
]
EXTRAS = {"markdown", "snippets", "regex", "xpath"}
# --- end of fixed values

HITS = "array<struct<selector:string,value:string,source:string,groups:map<int,string>,start:int,stop:int>>"
_HIT = pa.struct([("selector", pa.string()), ("value", pa.string()), ("source", pa.string()),
                  ("groups", pa.map_(pa.int32(), pa.string())), ("start", pa.int32()), ("stop", pa.int32())])


def is_hazardous(pattern: str) -> bool:
    return any(re.search(h, pattern) for h in HAZARDS)


def usable_patterns(patterns: list[str]) -> list[str]:
    """Patterns that compile and do not look dangerous, in the order given."""
    def compiles(p: str) -> bool:
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    return [p for p in patterns if not is_hazardous(p) and compiles(p)]


def requested_extras(names: list[str]) -> tuple[list[str], list[str]]:
    """Known extras, lower-cased, and the rejected rest."""
    low = [n.lower() for n in names]
    return [n for n in low if n in EXTRAS], [n for n in low if n not in EXTRAS]


def needed_columns(extras: list[str]) -> list[str]:
    """Columns that a set of extras reads beyond those shown."""
    needed = set()
    for name in extras:
        needed |= {"content", "headers"} if name in ("regex", "snippets") else {"content"}
    return sorted(needed)


def accepted(patterns: list[str]) -> list[str]:
    """The patterns, if all of them are usable; the message of the ``ValueError`` names the others."""
    usable = usable_patterns(patterns)
    if rejected := [p for p in patterns if p not in usable]:
        raise ValueError(f"patterns that do not compile or may take very long: {rejected}")
    return usable


def extract_regex(resources: DataFrame, patterns: list[str]) -> DataFrame:
    """Every match in headers, then content: value, groups that took part, character offsets."""
    usable = accepted(patterns)

    @F.arrow_udf(HITS)
    def run(headers: pa.Array, content: pa.Array) -> pa.Array:
        compiled = [re.compile(p) for p in usable]

        def hits(sources):
            for p in compiled:
                for name, text in sources:
                    for m in p.finditer(text or ""):
                        groups = [(i, g) for i, g in enumerate(m.groups(), 1) if g is not None]
                        yield {"selector": p.pattern, "value": m.group(), "source": name, "groups": groups,
                               "start": m.start(), "stop": m.end()}

        kind = pa.list_(_HIT)
        parts = [pa.array([list(hits((("headers", h.as_py()), ("content", c.as_py()))))], kind)
                 for h, c in zip(headers, content)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    found = spread(resources.select("site", "id", "url", "headers", "content")).select("site", "id", "url", F.posexplode(run("headers", "content")).alias("pos", "h"))
    return found.select("site", "id", "url", "pos", "h.*")


def extract_regex_values(resources: DataFrame, patterns: list[str]) -> DataFrame:
    """The same matches without offsets, evaluated natively (patterns in Java syntax).

    Groups that are empty or took no part are left out.
    """
    usable = accepted(patterns)
    if not usable:
        none = "CAST(NULL AS STRING) AS selector, CAST(NULL AS STRING) AS source, 0 AS n, CAST(NULL AS STRING) AS value, CAST(map() AS map<int,string>) AS groups"
        return resources.selectExpr("site", "id", "url", *none.split(", ")).limit(0)
    counts = {p: re.compile(p).groups for p in usable}
    widest = max(counts.values(), default=0)

    def zipped(column: str, pattern: str):
        whole = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
        groups = [F.regexp_extract_all(column, F.lit(pattern), F.lit(g)) if g <= counts[pattern]
                  else F.transform(whole, lambda _: F.lit("")) for g in range(1, widest + 1)]
        names = ["value"] + [f"g{g}" for g in range(1, widest + 1)]
        return F.arrays_zip(*[c.alias(n) for c, n in zip([whole, *groups], names)])

    searches = F.array(*[F.struct(F.lit(p).alias("selector"), F.lit(c).alias("source"), zipped(c, p).alias("hits"))
                         for p in usable for c in ("headers", "content")])
    runs = spread(resources.select("site", "id", "url", "headers", "content")).select("site", "id", "url", F.explode(searches).alias("s"))
    hits = runs.select("site", "id", "url", "s.selector", "s.source", F.posexplode("s.hits").alias("n", "h"))
    pairs = F.array(*[F.struct(F.lit(g).alias("key"), F.col(f"h.g{g}").alias("value")) for g in range(1, widest + 1)])
    groups = (F.map_from_entries(F.filter(pairs, lambda p: p["value"] != "")) if widest
              else F.create_map().cast("map<int,string>"))
    return hits.select("site", "id", "url", "selector", "source", "n", F.col("h.value").alias("value"),
                       groups.alias("groups"))

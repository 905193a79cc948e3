"""HTML elements as rows.

One Arrow pass turns a page into ``dom``: its markup and an array of nodes.  Everything
after that is native and works inside the row - selecting, counting and collecting text
need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.htmltree import flatten
from .groups import spread

DOM = ("struct<html:string,lead:string,nodes:array<struct<node:int,parent:int,depth:int,last:int,kind:string,"
       "tag:string,path:string,attrs:map<string,string>,text:string,tail:string,start:int,stop:int,tail_stop:int>>>")
PARSED_BYTES = 1 << 20  # markup whose nodes are held at once inside a task
_NODE = pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("last", pa.int32()),
                   ("kind", pa.string()), ("tag", pa.string()), ("path", pa.string()),
                   ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("tail", pa.string()),
                   ("start", pa.int32()), ("stop", pa.int32()), ("tail_stop", pa.int32())])
_DOM = pa.struct([("html", pa.string()), ("lead", pa.string()), ("nodes", pa.list_(_NODE))])


def parsed(batches: Iterator[pa.Array], paths: bool = True) -> Iterator[pa.Array]:
    """Pages as ``DOM``, in pieces of bounded markup: the nodes of a page are many times its size."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // PARSED_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:]):
            # page by page into Arrow: the Python rows of a whole piece would be many times its size
            parts = [pa.array([flatten(p.as_py(), paths) if p.is_valid and p.as_py().strip() else None], _DOM) for p in batch.slice(a, b - a)]
            yield pa.concat_arrays(parts) if parts else pa.array([], _DOM)


def parse(html: Column, paths: bool = True) -> Column:
    """Parsed page, NULL for missing or blank input.

    ``paths`` are as long as a node is deep; leave them out where no selector asks for them.
    """
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return parsed(batches, paths)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # not repeatable in the optimizer's eyes, or it would parse once more to filter empty pages
    return F.arrow_udf(run, DOM).asNondeterministic()(html)


def shred_html(resources: DataFrame, paths: bool = True) -> DataFrame:
    """(site, id, url, dom) of the HTML rows; without ``paths`` selectors by path find nothing."""
    pages = resources.where((F.col("type") == "html") & F.col("content").isNotNull())
    return spread(pages.select("site", "id", "url", "content")).select("site", "id", "url", parse(F.col("content"), paths).alias("dom"))


def nodes(shredded: DataFrame) -> DataFrame:
    """One row per element, comment or processing instruction."""
    return shredded.select("site", "id", "url", F.explode("dom.nodes").alias("n")).select("site", "id", "url", "n.*")


def _matches(node: Column, tag: str | None, attr: str | None, path: str | None, equals: dict[str, str],
             contains: dict[str, str] | None = None, missing: list[str] | None = None) -> Column:
    test = node["kind"] == "element"
    if tag is not None:
        test = test & (node["tag"] == tag)
    if path is not None:
        test = test & node["path"].rlike(path)
    if attr is not None:
        test = test & F.map_contains_key(node["attrs"], attr)
    for name, value in equals.items():
        test = test & (F.try_element_at(node["attrs"], F.lit(name)) == value)
    for name, part in (contains or {}).items():
        test = test & F.contains(F.try_element_at(node["attrs"], F.lit(name)), F.lit(part))
    for name in missing or []:
        test = test & ~F.map_contains_key(node["attrs"], name)
    return F.coalesce(test, F.lit(False))


def _value(dom: Column, n: Column, attr: str | None, text: bool, tail: bool) -> Column:
    if attr is not None:
        return F.try_element_at(n["attrs"], F.lit(attr))
    if text:
        return n["text"]
    stop = n["tail_stop"] if tail else n["stop"]
    return F.substring(dom["html"], n["start"] + 1, stop - n["start"])


def select_nodes(shredded: DataFrame, tag: str | None = None, attr: str | None = None, text: bool = False,
                 path: str | None = None, equals: dict[str, str] | None = None, tail: bool = True,
                 contains: dict[str, str] | None = None, missing: list[str] | None = None) -> DataFrame:
    """One row per hit: an attribute's value, the element's own text, or its outer HTML.

    ``path`` is a pattern on ``/html/body/...``; ``equals`` fixes attribute values, ``contains`` parts of them, and
    ``missing`` names attributes that must not be there.
    Outer HTML includes the text right after the element unless ``tail`` is off.
    """
    how = {"tag": tag, "attr": attr, "text": text, "path": path, "equals": equals, "tail": tail, "contains": contains, "missing": missing}
    return select_all(shredded, [how]).drop("selector")


def select_all(shredded: DataFrame, selectors: list[dict]) -> DataFrame:
    """Hits of several selectors, each marked with its number; pages are parsed once."""
    if not selectors:
        return shredded.select("site", "id", "url").limit(0)

    def hits(number: int, how: dict) -> Column:
        tail, text, attr = how.get("tail", True), how.get("text", False), how.get("attr")
        found = F.filter("dom.nodes", lambda n: _matches(n, how.get("tag"), attr, how.get("path"), how.get("equals") or {}, how.get("contains"), how.get("missing")))
        values = F.transform(found, lambda n: F.struct(
            F.lit(number).alias("selector"), n["node"].alias("node"), F.trim(_value(F.col("dom"), n, attr, text, tail)).alias("value")))
        # an element without own text is no hit of a text selector
        return F.filter(values, lambda v: v["value"] != "") if text and attr is None else values

    rows = F.flatten(F.array(*[hits(i, how) for i, how in enumerate(selectors)]))
    return shredded.select("site", "id", "url", F.explode(rows).alias("h")).select("site", "id", "url", "h.*")


def count_nodes(shredded: DataFrame, tag: str | None = None, path: str | None = None, attr: str | None = None, equals: dict[str, str] | None = None,
                contains: dict[str, str] | None = None, missing: list[str] | None = None) -> DataFrame:
    """Number of matching elements per page, zero included; the tests are those of ``select_nodes``."""
    hits = F.filter("dom.nodes", lambda n: _matches(n, tag, attr, path, equals or {}, contains, missing))
    return shredded.select("site", "id", "url", F.coalesce(F.size(hits), F.lit(0)).cast("long").alias("n"))


def sum_nodes(shredded: DataFrame, tag: str | None = None, attr: str | None = None, path: str | None = None, equals: dict[str, str] | None = None,
              contains: dict[str, str] | None = None, missing: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Sum of the numbers in an attribute, or in the own text, of the matching elements of a page, and how many were no numbers.

    With ``pattern`` its first group is the number.  An element without the attribute holds no number.  No match sums to 0.
    """
    hits = F.filter("dom.nodes", lambda n: _matches(n, tag, None, path, equals or {}, contains, missing))
    of = lambda n: n["text"] if attr is None else F.try_element_at(n["attrs"], F.lit(attr))
    found = lambda n: of(n) if pattern is None else F.regexp_extract(of(n), pattern, 1)
    numbers = F.transform(hits, lambda n: F.trim(found(n)).try_cast("double"))
    counted = shredded.select("site", "id", "url", F.coalesce(numbers, F.array().cast("array<double>")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return counted.select("site", "id", "url", total.alias("total"), F.size(F.filter("v", lambda x: x.isNull())).cast("long").alias("without_number"))


def component_columns(dom: Column, content: Column) -> dict[str, Column]:
    """Visible text, attribute values, comments and markup names of a parsed page."""
    def opaque(n: Column) -> Column:
        return (n["kind"] != "element") | F.coalesce(n["tag"].isin("script", "style"), F.lit(False))

    def joined(parts: Column) -> Column:
        return F.coalesce(tx.squash(F.array_join(F.flatten(parts), " ")), F.lit(""))

    all_nodes = dom["nodes"]
    elements = F.filter(all_nodes, lambda n: n["kind"] == "element")
    plain = F.filter(all_nodes, lambda n: ~opaque(n))
    none = F.array().cast("array<string>")
    body = F.transform(all_nodes, lambda n: F.when(opaque(n), F.array(n["tail"])).otherwise(F.array(n["text"], n["tail"])))
    text = tx.squash(F.concat_ws(" ", dom["lead"], joined(body)))
    return {
        "text": F.when(dom.isNull(), tx.squash(F.coalesce(content, F.lit("")))).otherwise(text),
        "attributes": tx.squash(F.regexp_replace(joined(F.transform(plain, lambda n: F.map_values(n["attrs"]))),
                                                 r"[\s_]+|(?<![\p{L}\p{N}_])-(?![\p{L}\p{N}_])", " ")),
        "comments": joined(F.transform(F.filter(all_nodes, lambda n: n["kind"] != "element"), lambda n: F.array(n["text"]))),
        "markup": joined(F.transform(elements, lambda n: F.concat(
            F.array(n["tag"]), F.when(opaque(n), none).otherwise(F.map_keys(n["attrs"]))))),
    }


def page_components(resources: DataFrame) -> DataFrame:
    """The texts of a resource by kind, for any type of content."""
    page = F.col("content")
    parsed = spread(resources.select("site", "id", "url", "headers", "content")).select("site", "id", "url", tx.squash(F.coalesce("headers", F.lit(""))).alias("headers"),
                              page, parse(page, paths=False).alias("dom"))
    parts = component_columns(F.col("dom"), F.col("content"))
    return parsed.select("site", "id", "url", "headers", *[c.alias(n) for n, c in parts.items()])

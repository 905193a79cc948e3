"""Derived tables for the rows of a search: one long table per requested extra."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import dom
from .extract import extract_regex, requested_extras, usable_patterns
from .markdown import to_markdown
from .query import Query, search
from .snippets import snippets


def search_extras(resources: DataFrame, query: Query, names: list[str], patterns: list[str] | None = None,
                  selectors: list[dict] | None = None, site_ids: list[int] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """Tables by extra name, and what was rejected: names that are not known, patterns that are not usable.

    ``patterns`` feed ``regex``; each of ``selectors`` holds arguments of ``select_nodes`` and
    feeds ``xpath``.  Pages are parsed only after the search has filtered them.
    """
    known, rejected = requested_extras(names)
    hits = search(resources, query, site_ids)
    tables: dict[str, DataFrame] = {}
    if "markdown" in known:
        tables["markdown"] = to_markdown(hits)
    if "snippets" in known:
        tables["snippets"] = snippets(resources, query, site_ids)
    if "regex" in known:
        usable = usable_patterns(patterns or [])
        rejected = rejected + [p for p in patterns or [] if p not in usable]
        tables["regex"] = extract_regex(hits, usable)
    if "xpath" in known:
        tables["xpath"] = dom.select_all(dom.shred_html(hits), selectors or [])
    return tables, rejected

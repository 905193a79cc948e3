"""Boolean search as composable predicates.

``(q.text("privacy") & q.field("type", "html")) - q.text("cookie")`` builds a small
expression that turns into one Spark ``Column`` (scan mode) or into a
small program (index mode, see ``saved`` and ``index``).  NOT binds tighter than AND, AND
tighter than OR, and nesting is kept as written.  Every atom is false, never NULL,
on missing text, so complements keep rows without content.
"""

from __future__ import annotations

import operator
import dataclasses
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as tx

TEXT_FIELDS = ("id", "site", "url", "type", "headers", "content")
NUMERIC_FIELDS = ("id", "status", "size", "time")
COMPARISONS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt,
               "<=": operator.le, ">": operator.gt, ">=": operator.ge}
MATCH_ALL = {"", '""', "''", "*", "``"}
TERM_FIELDS = {"content", "headers"}


class Query:
    """Base of all predicates; combine with ``&``, ``|``, ``-`` and ``~``."""

    def __and__(self, other: "Query") -> "Query":
        return And(self, other)

    def __or__(self, other: "Query") -> "Query":
        return Or(self, other)

    def __sub__(self, other: "Query") -> "Query":
        return And(self, Not(other))

    def __invert__(self) -> "Query":
        return Not(self)

    def condition(self) -> Column:
        """For WHERE, where NULL counts as false: free of wrappers, so that it reaches the scan."""
        raise NotImplementedError

    def column(self) -> Column:
        """The same as a flag that is never NULL."""
        return F.coalesce(self.condition(), F.lit(False))

    def atoms(self) -> list["Query"]:
        return [self]

    def mentions(self, name: str) -> bool:
        return any(getattr(a, "name", None) == name for a in self.atoms())

    def terms(self) -> list[str]:
        """Free-text terms in the order written, lower-cased, for snippets."""
        found = [a.source for a in self.atoms() if isinstance(a, Text)
                 and (len(a.fields) > 1 or a.fields[0] in TERM_FIELDS)]
        return [t for t in (s.lower().strip("*") for s in found) if t]


@dataclass(frozen=True)
class All(Query):
    def condition(self) -> Column:
        return F.lit(True)



@dataclass(frozen=True)
class Text(Query):
    """Consecutive tokens inside one field; ``prefix`` makes the last one a stem."""

    words: tuple[str, ...]
    fields: tuple[str, ...] = TEXT_FIELDS
    prefix: bool = False
    source: str = dataclasses.field(default="", compare=False)

    @property
    def name(self) -> str | None:
        return self.fields[0] if len(self.fields) == 1 else None

    @property
    def possible_fields(self) -> list[str]:
        """Fields worth a look: ids are single tokens of digits."""
        if len(self.words) == 1 and self.words[0].isdigit():
            return list(self.fields)
        return [f for f in self.fields if f not in ("id", "site")]

    def condition(self) -> Column:
        return _fold(operator.or_, [F.lit(False)] + [
            tx.has_tokens(F.col(f).cast("string"), list(self.words), self.prefix) for f in self.possible_fields])


@dataclass(frozen=True)
class Url(Query):
    """Case-insensitive substring of the URL."""

    part: str
    name: str = "url"

    def condition(self) -> Column:
        return F.lower("url").contains(self.part)


@dataclass(frozen=True)
class Number(Query):
    name: str
    op: str
    value: int | float

    def condition(self) -> Column:
        return COMPARISONS[self.op](F.col(self.name), F.lit(self.value))


@dataclass(frozen=True)
class Member(Query):
    """Value of a column is one of a short list."""

    name: str
    values: tuple

    def condition(self) -> Column:
        return F.col(self.name).isin(list(self.values))


class _Compound(Query):
    def __init__(self, *parts: Query):
        self.parts = parts

    def atoms(self) -> list[Query]:
        return [a for p in self.parts for a in p.atoms()]


class And(_Compound):
    def condition(self) -> Column:
        return _fold(operator.and_, [p.condition() for p in self.parts])



class Or(_Compound):
    def condition(self) -> Column:
        return _fold(operator.or_, [p.condition() for p in self.parts])



class Not(_Compound):
    def condition(self) -> Column:
        return ~self.parts[0].column()



def _fold(op, columns: list[Column]) -> Column:
    result = columns[0]
    for c in columns[1:]:
        result = op(result, c)
    return result


class _NumberField:
    """``q.status >= 400`` and friends."""

    __hash__ = None

    def __init__(self, name: str):
        self.name = name

    def _compare(self, op: str, value) -> Number:
        return Number(self.name, op, _number(value))

    def __eq__(self, value):
        return self._compare("=", value)

    def __ne__(self, value):
        return self._compare("!=", value)

    def __lt__(self, value):
        return self._compare("<", value)

    def __le__(self, value):
        return self._compare("<=", value)

    def __gt__(self, value):
        return self._compare(">", value)

    def __ge__(self, value):
        return self._compare(">=", value)


def _number(value) -> int | float:
    if isinstance(value, (int, float)):
        return value
    try:
        return int(value)
    except ValueError:
        return float(value)


id, status, size, time = (_NumberField(n) for n in NUMERIC_FIELDS)


def number(name: str, op: str, value) -> Query:
    """Comparison of a numeric field given by name."""
    if name not in NUMERIC_FIELDS:
        raise ValueError(f"not a numeric field: {name}")
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison: {op}")
    return Number(name, op, _number(value))


def text(term: str) -> Query:
    """A term in any field.  Several tokens (``text/xml``) mean a phrase; ``*`` ends a stem."""
    return Text(tuple(tx.split_tokens(term)), prefix=term.endswith("*"), source=term)


phrase = text


def prefix(stem: str) -> Query:
    return Text(tuple(tx.split_tokens(stem)), prefix=True, source=stem)


def field(name: str, term) -> Query:
    """A term in one field, a list of types, or a URL part."""
    if name == "url":
        return url(term)
    if not isinstance(term, str):
        return types(term) if name == "type" else number(name, "=", term)
    if name not in TEXT_FIELDS:
        return number(name, "=", term)
    if name == "type" and term.strip().lower() in S.TYPES:
        return Member("type", (term.strip().lower(),))
    return replace(text(term), fields=(name,))


def url(part: str) -> Query:
    return Url(part.strip("*\"'`").lower())


def types(names: list[str]) -> Query:
    """One of several types; unknown names are ignored, none left means no filter."""
    known = tuple(n for n in names if n in S.TYPES)
    return Member("type", known) if known else All()


def type_codes(names: list[str]) -> Query:
    """The same test against integer-coded types, as stored in database exports."""
    codes = tuple(c for c, n in S.TYPE_CODES.items() if n in names)
    return Member("type", codes) if codes else All()


def sites(ids: list[int] | None) -> Query:
    """Site scope; ``None`` means all sites, unknown ids match nothing."""
    return All() if ids is None else Member("site", tuple(ids))


def match_all() -> Query:
    return All()


def any_of(value: str) -> Query:
    """A single user-supplied term, where empty or wildcard input means no filter."""
    return All() if value.strip() in MATCH_ALL else text(value)


def only_html(query: Query) -> Query:
    return field("type", "html") & query


def effective(query: Query, site_ids: list[int] | None = None) -> Query:
    """The query as run: within its sites, and only captured responses unless it asks for status."""
    scoped = query if site_ids is None else sites(site_ids) & query
    return scoped if query.mentions("status") else scoped & Number("status", ">=", 100)


def search(resources: DataFrame, query: Query, site_ids: list[int] | None = None) -> DataFrame:
    """Rows of the resource table that satisfy the query (scan mode)."""
    run = effective(query, site_ids)
    # one filter per conjunct lets the cheap ones reach the scan on their own
    parts = [run]
    while any(isinstance(p, And) for p in parts):
        parts = [s for p in parts for s in (p.parts if isinstance(p, And) else (p,))]
    parts.sort(key=lambda p: isinstance(p, (Text, _Compound)))
    for part in parts:
        resources = resources.where(part.condition())
    return resources


def find_homepage(resources: DataFrame, domain: str, site_ids: list[int] | None = None) -> DataFrame:
    """The first HTML page, by URL, whose URL contains the domain."""
    hits = search(resources, field("type", "html") & url(domain), site_ids)
    return hits.orderBy("url", "id").limit(1)

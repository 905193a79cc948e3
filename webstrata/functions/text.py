"""Tokens and token patterns.

A token is a maximal run of letters, numbers, private-use characters, ``_`` and
``-``, lower-cased, with diacritics kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_CLASS = r"\p{L}\p{N}\p{Co}_-"
TOKEN_CHAR = f"[{TOKEN_CLASS}]"
TOKEN_PATTERN = f"{TOKEN_CHAR}+"
SEPARATOR = f"[^{TOKEN_CLASS}]"


def tokens(col: Column) -> Column:
    """All tokens of a text in order; NULL stays NULL."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def split_tokens(value: str) -> list[str]:
    """The same tokenizer for a short literal on the driver."""
    def kept(ch: str) -> bool:
        category = unicodedata.category(ch)
        return category[0] in "LN" or category == "Co" or ch in "_-"

    return "".join(ch if kept(ch) else " " for ch in value.lower()).split()


def has_tokens(col: Column, words: list[str], prefix: bool = False, lowered: bool = False) -> Column:
    """True where ``words`` are consecutive tokens of ``col``; the last may be a stem.  NULL for NULL.

    The text is tested in place, without building a token array: a substring test
    on the longest word discards most rows, the pattern then checks the borders.
    """
    if not words:
        return F.lit(False)
    low = col if lowered else F.lower(col)
    # the pattern starts with plain letters and looks back only where they occur
    first, rest = words[0], words[1:]
    pattern = f"{first}(?<!{TOKEN_CHAR}{first})" + "".join(f"{SEPARATOR}+{w}" for w in rest)
    pattern += "" if prefix else f"(?!{TOKEN_CHAR})"
    return low.contains(max(words, key=len)) & low.rlike(pattern)


def squash(col: Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def running(values: Column | str, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals within an array, for an associative ``combine`` of whole numbers (sum, greatest).

    Each element takes in the one 1, 2, 4, ... places before it, so n elements need n log n steps and no copies of
    growing arrays.
    """
    numbers = F.transform(F.col(values) if isinstance(values, str) else values, lambda x: x.cast("int"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int"))
    shift = lambda r: F.pow(F.lit(2), r).cast("int")
    return F.aggregate(rounds, numbers, lambda acc, r: F.transform(
        acc, lambda x, i: F.when(i >= shift(r), combine(x, F.get(acc, i - shift(r)))).otherwise(x)))

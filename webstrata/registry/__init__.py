"""Named queries over the given tables, each with the SQL it must agree with.

Where no SQL is given the operator is checked in ``tests/`` against brute force.
"""

from __future__ import annotations

from . import audits, extraction, searching, shaping

MODULES = (searching, shaping, audits, extraction)


def registered() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}

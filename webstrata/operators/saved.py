"""Saved queries as data: text literals, tests of columns, and a small postfix program per query.

Every distinct text atom of a set of queries becomes one bit of a row, every distinct other atom one test of the
row's columns.  A query is a program over them: push a bit, push a test, AND, OR, NOT.  Its stack of truth values is the
bits of one number; of two branches the deeper one is computed first, so the stack stays as shallow as the logarithm of
the program.  Programs grow with the query as written, whatever its nesting; no normal form is built.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .query import All, And, Member, Not, Number, Or, Query, Text, Url, effective

TEXT, TEST, TRUE, AND, OR, NOT = range(6)
WORD_BITS = 64
_OPS = "array<struct<op:int,arg:int>>"
_TESTS = "array<struct<name:string,op:string,num:double,words:array<string>>>"
_QUERIES = f"array<struct<query_id:string,ops:{_OPS},mask:array<bigint>,open:boolean>>"


@dataclass
class Programs:
    texts: dict[Text, int] = field(default_factory=dict)   # text literal -> bit
    tests: dict[tuple, int] = field(default_factory=dict)  # (name, op, number, values) -> number of the test
    queries: list[tuple] = field(default_factory=list)     # (query_id, operations, bits in use, open)

    @property
    def words(self) -> int:
        """Numbers that hold the bits of a row."""
        return max(1, -(-len(self.texts) // WORD_BITS))

    def number(self, atom: Query) -> tuple[int, int]:
        if isinstance(atom, Text):
            return TEXT, self.texts.setdefault(atom, len(self.texts))
        if isinstance(atom, All):
            return TRUE, 0
        if isinstance(atom, Number):
            test = (atom.name, atom.op, float(atom.value), ())
        elif isinstance(atom, Url):
            test = ("url", "contains", None, (atom.part,))
        else:
            test = (atom.name, "in", None, tuple(str(v) for v in atom.values))
        return TEST, self.tests.setdefault(test, len(self.tests))


def compiled(queries: dict[str, Query]) -> Programs:
    """The queries as they are run, as programs."""
    made = Programs()
    for query_id, query in queries.items():
        program, _, (possible, _) = _emit(effective(query), made)
        made.queries.append((query_id, program, {arg for op, arg in program if op == TEXT}, possible))
    return made


def _emit(query: Query, made: Programs) -> tuple[list[tuple[int, int]], int, tuple[bool, bool]]:
    """Program, stack needed, and whether it can be true or false in a row that holds none of the texts."""
    if isinstance(query, Not):
        program, need, (true, false) = _emit(query.parts[0], made)
        return [*program, (NOT, 0)], need, (false, true)
    if isinstance(query, (And, Or)):
        parts = sorted((_emit(p, made) for p in query.parts), key=lambda p: -p[1])
        program = list(parts[0][0])
        for part, _, _ in parts[1:]:
            program += [*part, (AND if isinstance(query, And) else OR, 0)]
        need = max(parts[0][1], *(1 + n for _, n, _ in parts[1:]), 1)
        every, some = (0, 1) if isinstance(query, And) else (1, 0)
        outcome = [False, False]
        outcome[every], outcome[some] = all(o[every] for *_, o in parts), any(o[some] for *_, o in parts)
        return program, need, (outcome[0], outcome[1])
    op, arg = made.number(query)
    return [(op, arg)], 1, {TEXT: (False, True), TEST: (True, True), TRUE: (True, False)}[op]


def _bit(bits: Column, arg: Column) -> Column:
    word = F.get(bits, (arg / WORD_BITS).cast("int"))
    return F.call_function("shiftright", word, arg % WORD_BITS).bitwiseAND(F.lit(1).cast("long"))


def bit(literal: Column, word: int) -> Column:
    """The bit of a literal in the row's ``word``-th number, 0 if it belongs to another."""
    return F.when((literal / WORD_BITS).cast("int") == word, F.call_function("shiftleft", F.lit(1).cast("long"), literal % WORD_BITS)).otherwise(F.lit(0).cast("long"))


def _tested(tests: Column) -> Column:
    """Whether the current row passes each test; never NULL."""
    def one(t: Column) -> Column:
        left = (F.when(t["name"] == "status", F.col("status").cast("double")).when(t["name"] == "size", F.col("size").cast("double"))
                .when(t["name"] == "time", F.col("time").cast("double")).when(t["name"] == "id", F.col("id").cast("double")))  # ids have 48 bits
        right = t["num"]
        held = (F.when(t["op"] == "=", left == right).when(t["op"] == "!=", left != right).when(t["op"] == "<", left < right)
                .when(t["op"] == "<=", left <= right).when(t["op"] == ">", left > right).when(t["op"] == ">=", left >= right)
                .when(t["op"] == "contains", F.contains(F.lower("url"), F.get(t["words"], F.lit(0))))
                .when(t["name"] == "site", F.array_contains(t["words"], F.col("site").cast("string")))
                .when(t["name"] == "type", F.array_contains(t["words"], F.col("type"))))
        return F.coalesce(held, F.lit(False))
    return F.transform(tests, one)


def _outcome(bits: Column, flags: Column, ops: Column) -> Column:
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")

    def step(stack: Column, o: Column) -> Column:
        pushed = F.when(o["op"] == TEXT, _bit(bits, o["arg"])).when(o["op"] == TEST, F.get(flags, o["arg"]).cast("long")).otherwise(one)
        top, below = stack.bitwiseAND(one), F.call_function("shiftright", stack, F.lit(1)).bitwiseAND(one)
        joined = F.when(o["op"] == AND, top.bitwiseAND(below)).otherwise(top.bitwiseOR(below))
        return (F.when(o["op"] == NOT, stack.bitwiseXOR(one)).when(o["op"] <= TRUE, stack * two + pushed)
                .otherwise(F.call_function("shiftleft", F.call_function("shiftright", stack, F.lit(2)), F.lit(1)) + joined))

    return F.aggregate(ops, F.lit(0).cast("long"), step).bitwiseAND(one) == one


def answered(programs: Programs, bits: Column) -> Column:
    """Ids of the queries that the current row (its columns and its bits) satisfies.

    A query is run only if the row holds one of its texts, or if it can be true without any.
    """
    names = ("name", "op", "num", "words")
    tests = F.from_json(F.lit(json.dumps([dict(zip(names, (n, o, v, list(w)))) for n, o, v, w in programs.tests])), _TESTS)
    signed = lambda x: x - (1 << WORD_BITS) if x >> (WORD_BITS - 1) else x
    masks = [[signed(sum(1 << (a % WORD_BITS) for a in args if a // WORD_BITS == w)) for w in range(programs.words)] for _, _, args, _ in programs.queries]
    cases = [{"query_id": q, "ops": [{"op": o, "arg": a} for o, a in ops], "mask": mask, "open": possible}
             for (q, ops, _, possible), mask in zip(programs.queries, masks)]
    queries = F.from_json(F.lit(json.dumps(cases)), _QUERIES)
    flags = _tested(tests)
    held = lambda q: F.exists(F.zip_with(q["mask"], bits, lambda m, b: m.bitwiseAND(b)), lambda x: x != 0)
    return F.transform(F.filter(queries, lambda q: (q["open"] | held(q)) & _outcome(bits, flags, q["ops"])), lambda q: q["query_id"])

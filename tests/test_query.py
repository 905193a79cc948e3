"""Boolean search: laws, random trees against a plain evaluator, an independent text matcher, both modes."""

import functools
import time
import uuid
import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webstrata.functions import text as tx
from webstrata.operators import postings as P
from webstrata.operators import saved
from webstrata.operators.groups import work_folder
from webstrata.operators import index as index_module
from webstrata.operators.index import Index
from webstrata.operators import query as q
from webstrata.schema import RESOURCE

WORDS = ["alpha", "beta", "al", "x-1", "café", "alpine"]
ROWS = [
    (1, i, url, kind, status, size, i * 10, headers, content, None, None)
    for i, (url, kind, status, size, headers, content) in enumerate([
        ("http://a.com/alpha", "html", 200, 10, "h: beta", "alpha beta gamma"),
        ("http://a.com/b", "html", 404, 20, "h: x", "beta alpha"),
        ("http://b.com/_pct%", "img", 200, 30, "h: y", None),
        ("http://b.com/alpine", "style", 500, 40, None, "Alpine x-1 CAFÉ"),
        ("http://c.com/", "html", 0, 50, "alpha", "beta, alpha; beta"),
        ("http://c.com/d", "text", 301, 60, "text/xml", ""),
        ("http://d.com/e", "script", 200, 70, "alpha\r\nbeta", "x-1 al alpha x"),
    ], 1)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, RESOURCE).cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def find(table, query, sites=None):
    return ids(q.search(table, query, sites))


# -------- plain evaluator on the same atoms

def matches(atom, row):
    if isinstance(atom, q.Text):
        values = [{"id": row.id, "site": row.site, "url": row.url, "type": row.type, "headers": row.headers,
                   "content": row.content}[f] for f in atom.fields]
        return any(consecutive(tx.split_tokens(str(v)), atom) for v in values if v is not None)
    if isinstance(atom, q.Url):
        return atom.part in row.url.lower()
    if isinstance(atom, q.Number):
        return q.COMPARISONS[atom.op](getattr(row, atom.name), atom.value)
    if isinstance(atom, q.Member):
        return getattr(row, atom.name) in atom.values
    if isinstance(atom, q.And):
        return all(matches(p, row) for p in atom.parts)
    if isinstance(atom, q.Or):
        return any(matches(p, row) for p in atom.parts)
    if isinstance(atom, q.Not):
        return not matches(atom.parts[0], row)
    return True


def consecutive(tokens, atom):
    n = len(atom.words)
    for i in range(len(tokens) - n + 1):
        window = tokens[i:i + n]
        last = window[-1].startswith(atom.words[-1]) if atom.prefix else window[-1] == atom.words[-1]
        if window[:-1] == list(atom.words[:-1]) and last:
            return True
    return False


atoms = st.one_of(
    st.sampled_from(WORDS).map(q.text), st.sampled_from(["al", "be", "x"]).map(q.prefix),
    st.tuples(st.sampled_from(WORDS), st.sampled_from(WORDS)).map(lambda p: q.phrase(" ".join(p))),
    st.tuples(st.sampled_from(["content", "headers", "type"]), st.sampled_from(WORDS + ["html"])).map(lambda p: q.field(*p)),
    st.sampled_from(["a.com", "B.COM", "_", "%"]).map(q.url),
    st.tuples(st.sampled_from(["status", "size", "time", "id"]), st.sampled_from(sorted(q.COMPARISONS)),
              st.sampled_from([0, 3, 30, 200, 404])).map(lambda p: q.number(*p)),
    st.just(q.types(["html", "img"])), st.just(q.match_all()))
trees = st.recursive(atoms, lambda s: st.one_of(
    st.tuples(s, s).map(lambda p: p[0] & p[1]), st.tuples(s, s).map(lambda p: p[0] | p[1]),
    st.tuples(s, s).map(lambda p: p[0] - p[1]), s.map(lambda a: ~a)), max_leaves=6)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(trees, min_size=6, max_size=6))
def test_scan_and_index_agree_with_plain_evaluation(table, batch):
    rows = table.collect()
    wanted = {f"q{i}": sorted(r.id for r in rows if matches(q.effective(t), r)) for i, t in enumerate(batch)}
    flags = table.select("id", *[q.effective(t).column().alias(f"q{i}") for i, t in enumerate(batch)]).collect()
    assert {n: sorted(r.id for r in flags if r[n]) for n in wanted} == wanted
    found = indexed(table).search({f"q{i}": t for i, t in enumerate(batch)}).collect()
    assert {n: sorted(r.id for r in found if r.query_id == n) for n in wanted} == wanted


def test_laws(pages):
    a, b = q.field("content", "and"), q.field("content", "of")

    def n(query):
        return q.search(pages, query).count()

    assert n(a | b) == n(a) + n(b) - n(a & b)
    assert n(a - b) == n(a) - n(a & b)
    assert n(a) + n(~a) == n(q.match_all())
    assert n(~(a | b)) == n(~a & ~b) and n(~(a & b)) == n(~a | ~b)
    assert max(n(a), n(b)) <= n(a | b) <= n(a) + n(b) and n(a & b) <= min(n(a), n(b))


def test_against_sqlite_full_text(pages):
    """SQLite's full-text index with the same token characters, on the same six columns."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(id, site, url, type, headers, content, "
                    "tokenize=\"unicode61 remove_diacritics 0 tokenchars '-_'\")")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    rows = pages.select("id", "site", "url", "type", "headers", "content").collect()
    con.executemany("INSERT INTO t VALUES (?,?,?,?,?,?)", [tuple(r) for r in rows])

    def fts(match):
        return sorted(int(r[0]) for r in con.execute("SELECT id FROM t WHERE t MATCH ?", (match,)))

    every = q.status >= 0
    for match, query in {
            "and": q.text("and"), '"of the"': q.phrase("of the"), "th*": q.prefix("th"), "content:was": q.field("content", "was"),
            "type:html": q.field("type", "html"), '"text html"': q.text("text/html"), "and NOT es": q.text("and") - q.text("es"),
            "(and OR de) AND html": (q.text("and") | q.text("de")) & q.text("html"), "é": q.text("é"), '"in th" *': q.text("in th*"),
            'headers:"content-length"': q.field("headers", "Content-Length")}.items():
        assert fts(match) == find(pages, query & every), match


def test_term_kinds(table):
    assert find(table, q.text("alpha")) == [1, 2, 7]
    assert find(table, q.text("alpha") & (q.status >= 0)) == [1, 2, 5, 7]
    assert find(table, q.text("CAFÉ")) == [4] and find(table, q.text("cafe")) == []
    assert find(table, q.phrase("beta alpha")) == [2]
    assert find(table, q.phrase("gamma beta")) == []                    # never across columns or in another order
    assert find(table, q.field("headers", "text/xml")) == [6]
    assert find(table, q.prefix("alp") & (q.size < 45)) == [1, 2, 4]
    assert find(table, q.prefix("x-")) == [4, 7]
    assert find(table, q.url("*A.com`")) == [1, 2]
    assert find(table, q.url("_pct%")) == [3] and find(table, q.url("b.com/%")) == []
    assert find(table, q.field("type", "HTML")) == [1, 2]
    assert find(table, q.text("!!")) == []


def test_precedence_and_groups(table):
    a, b, h = q.text("alpha"), q.text("beta"), q.field("type", "html")
    assert find(table, ~a & h) == []
    assert find(table, ~(a & b) & (q.size > 0)) == [3, 4, 6]
    assert find(table, ~((q.status == 404) | (q.status == 500))) == [1, 3, 5, 6, 7]
    assert find(table, (q.id == 1) | (q.id == 2) | (q.id == 3)) == [1, 2, 3]
    assert find(table, h & (q.url("a.com") | q.url("c.com"))) == [1, 2]
    assert find(table, (q.status == 404) | q.text("al")) == [2, 7]
    assert 3 in find(table, ~q.field("content", "alpha"))               # rows without content stay


def test_scope_and_defaults(table):
    assert find(table, q.match_all()) == [1, 2, 3, 4, 6, 7]             # status 0 is hidden unless asked for
    assert find(table, q.status == 0) == [5]
    assert find(table, q.any_of('""')) == find(table, q.any_of("*")) == [1, 2, 3, 4, 6, 7]
    assert find(table, q.match_all(), [1]) and find(table, q.match_all(), [9]) == []
    assert find(table, q.types(["img", "nope"])) == [3] and find(table, q.types(["nope"])) == [1, 2, 3, 4, 6, 7]
    assert [r.url for r in q.find_homepage(table, "a.com").collect()] == ["http://a.com/alpha"]
    assert ids(table.withColumn("type", F.lit(1)).where(q.type_codes(["html"]).column())) == [1, 2, 3, 4, 5, 6, 7]


def test_number_values():
    assert q.number("size", ">", "10").value == 10 and q.number("size", ">", "1.5").value == 1.5
    for bad in (("url", "=", 1), ("size", "~", 1), ("size", "=", "x")):
        with pytest.raises(ValueError):
            q.number(*bad)


def test_terms_for_snippets():
    query = (q.text("Privacy") & q.field("type", "html")) | q.field("content", "Coo*") - q.field("headers", "x y") & (q.size > 1)
    assert query.terms() == ["privacy", "coo", "x y"]


def test_repeated_words_in_a_phrase(spark):
    rows = [(1, 1, "u1", "html", 200, 1, 0, None, "to be or not to be", None, None),
            (1, 2, "u2", "html", 200, 1, 0, None, "to to be", None, None)]
    table = spark.createDataFrame(rows, RESOURCE)
    queries = {"a": q.phrase("to be or not to be"), "b": q.phrase("to to be"), "c": q.phrase("be to"), "d": q.phrase("not to b*")}
    found = indexed(table).search(queries).collect()
    assert sorted((r.query_id, r.id) for r in found) == [("a", 1), ("b", 2), ("d", 1)]


@functools.cache
def indexed(df):
    return Index(df.sparkSession, f"{work_folder(df.sparkSession)}/index-{uuid.uuid4().hex}").append(df)


def found(index, query):
    return sorted(r.id for r in index.search({"x": query}).collect())


def test_index_and_scan_agree_on_documents(documents):
    index = indexed(documents)
    queries = {"x": q.phrase("of the"), "y": q.text("de") - q.prefix("la"), "z": q.phrase("of the of") | q.prefix("the th"), "n": ~q.text("the")}
    got = index.search(queries).collect()
    assert {n: sorted(r.id for r in got if r.query_id == n) for n in queries} == {n: find(documents, t) for n, t in queries.items()}
    assert index.view().postings.count() == P.build_postings(documents).count()


def test_scans_of_the_index_get_the_tokens(documents):
    view = indexed(documents).view()
    plan = view.hits(saved.compiled({"x": q.phrase("of the"), "y": q.text("de")}))._jdf.queryExecution().explainString(view.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("Scan parquet") == 2 and all(x in plan for x in ("EqualTo(next,the)", "PartitionFilters: [field"))


def test_a_phrase_of_frequent_words_moves_only_its_pairs(documents):
    view = indexed(documents).view()
    hits = view.hits(saved.compiled({"x": q.phrase("of the")}))
    pairs = view.postings.where("token = 'of' AND next = 'the'").count()
    assert hits.count() == pairs < view.postings.where("token IN ('of', 'the')").count() / 4
    exchanges = view.search({"x": q.phrase("of the") & q.text("a"), "y": ~q.phrase("the of")})._jdf.queryExecution().executedPlan().toString()
    assert exchanges.count("Exchange hashpartitioning") <= 2                                          # postings and rows, once each


def test_stems_are_looked_up_in_the_vocabulary(documents):
    view = indexed(documents).view()
    plan = view.hits(saved.compiled({"x": q.prefix("thea"), "y": q.prefix("d")}))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,thea)" in plan
    assert found(indexed(documents), q.prefix("thea")) == find(documents, q.prefix("thea"))


def test_later_segments_replace_rows_and_merging_keeps_what_is_current(spark):
    row = lambda k, text, status=200: (1, k, f"u{k}", "html", status, 1, 0, None, text, None, None)
    make = lambda *rows: spark.createDataFrame(rows, RESOURCE)
    index = indexed(make(row(1, "alpha beta"), row(2, "alpha"), row(3, "gamma"), row(4, "alpha"))).append(make(row(2, "delta"), row(5, "alpha beta gamma")))
    index.append(make(row(4, None), row(1, "alpha beta", 404)))
    expected = {"alpha": [1, 5], "delta": [2], "gamma": [3, 5]}
    assert {w: found(index, q.text(w)) for w in expected} == expected and index.committed() == (0, [0, 1, 2])
    assert found(index, ~q.text("alpha")) == [2, 3, 4] and found(index, q.status == 404) == [1] and found(index, q.phrase("alpha beta gamma")) == [5]
    before = index.view()
    index.merge()
    assert index.committed() == (1, [0]) and {w: found(index, q.text(w)) for w in expected} == expected
    assert {(r.token, r.df) for r in index.view().terms().where("field = 'content'").collect()} == {("alpha", 2), ("beta", 2), ("gamma", 2), ("delta", 1)}
    assert sorted(r.id for r in before.search({"x": q.text("alpha")}).collect()) == [1, 5]           # an earlier view stays whole
    # an append that broke off leaves its files, but no commit
    make(row(9, "alpha")).select("site", "id", "url", "type", "status", "size", "time").write.parquet(f"{index.path}/generation=1/rows/segment=1")
    assert found(index, q.text("alpha")) == [1, 5] and found(index.append(make(row(6, "alpha"))), q.text("alpha")) == [1, 5, 6]


def test_rows_without_key_and_empty_tables(spark):
    schema = "site long, id long, url string, type string, status int, size long, time int, headers string, content string"
    index = indexed(spark.createDataFrame([(1, None, "u", "html", 200, 1, 0, None, "alpha"), (None, 2, "u", "html", 200, 1, 0, None, "alpha")], schema))
    assert found(index, q.text("alpha")) == [] and found(index, ~q.text("alpha")) == []
    with pytest.raises(ValueError):
        Index(spark, f"{work_folder(spark)}/index-none").view()


def test_programs_do_not_multiply_out(table):
    start = time.perf_counter()
    query = functools.reduce(lambda a, b: a & b, (q.text(f"a{k}") | q.text(f"b{k}") for k in range(200)))
    programs = saved.compiled({"x": query, "y": ~query})
    assert time.perf_counter() - start < 1 and len(programs.texts) == 400
    assert [len(ops) for _, ops, *_ in programs.queries] == [2 * 401 - 1, 2 * 401] and [possible for *_, possible in programs.queries] == [False, True]
    index = indexed(table)
    start = time.perf_counter()
    twenty = functools.reduce(lambda a, b: a & b, (q.text(f"a{k}") | q.text("alpha") for k in range(20)))
    plan = index.view().search({"x": twenty})
    plan._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - start < 4 and sorted(r.id for r in plan.collect()) == find(table, q.text("alpha"))


def test_more_literals_than_a_number_has_bits(table):
    every = functools.reduce(lambda a, b: a | b, [q.text(f"none{k}") for k in range(150)] + [q.text("beta")])
    sixty_fourth = {f"q{k}": q.text(f"w{k}") for k in range(63)} | {"last": q.text("alpha"), "next": q.text("beta"), "both": q.text("beta") - q.text("alpha")}
    index = indexed(table)
    assert found(index, every) == find(table, q.text("beta"))
    got = index.search(sixty_fourth).collect()
    assert {n: sorted(r.id for r in got if r.query_id == n) for n in ("last", "next", "both")} == {
        "last": find(table, q.text("alpha")), "next": find(table, q.text("beta")), "both": find(table, q.text("beta") - q.text("alpha"))}


def test_no_queries(table):
    index = indexed(table)
    assert index.search({"n": ~q.match_all()}).count() == 0 and index.search({}).count() == 0 and index.search({"e": q.text("!!")}).count() == 0


def test_postings_are_made_and_counted_in_tasks_of_bounded_text_without_travelling(spark, monkeypatch):
    text = " ".join(f"w{k % 700}" for k in range(20_000))
    rows = spark.createDataFrame([(1, k, f"u{k}", "html", 200, 1, 0, None, text) for k in range(12)] + [(1, 3, "u3", "html", 200, 1, 0, None, "w1 only")],
                                 "site long, id long, url string, type string, status int, size long, time int, headers string, content string")
    monkeypatch.setattr(index_module, "LEAST_BYTES", 1 << 18)
    monkeypatch.setattr(index_module, "TASK_BYTES", 1 << 18)
    assert index_module._tasks([12 * len(text)], spark) >= 5
    index = indexed(rows)
    files = index.view().postings.where("field = 'content'").select("site", "id", F.input_file_name().alias("file")).distinct().collect()
    assert len({r.file for r in files}) > 3 and len(files) == 12                 # a resource stands in one run only
    first = index.view().postings.where(F.input_file_name() == files[0].file).select("token", "next").collect()
    assert [tuple(r) for r in first] == sorted(tuple(r) for r in first)
    counts = {r.token: (r.df, r.cf) for r in index.view().terms().where("field = 'content' AND token IN ('w1', 'only')").collect()}
    assert counts == {"w1": (12, 12 * sum(k % 700 == 1 for k in range(20_000)) + 1), "only": (1, 1)}


def test_merging_neither_sorts_nor_moves_postings(spark, monkeypatch):
    make = lambda *rows: spark.createDataFrame([(1, k, f"u{k}", "html", 200, 1, 0, None, t, None, None) for k, t in rows], RESOURCE)
    terms = lambda i: {(r.field, r.token, r.df, r.cf) for r in i.view().terms().collect()}
    postings = lambda i: sorted(tuple(r) for r in i.view().postings.drop("segment").collect())
    whole = indexed(make((1, "a a b"), (2, "c"), (3, "a b a b"), (4, "d c")))
    for sent in (0, 100):
        monkeypatch.setattr(index_module, "SENT", sent)
        merged = indexed(make((1, "a old"), (2, "c"), (3, "x a"))).append(make((3, "b"), (4, "d c"))).append(make((1, "a a b"), (3, "a b a b"))).merge()
        assert terms(merged) == terms(whole) and postings(merged) == postings(whole)

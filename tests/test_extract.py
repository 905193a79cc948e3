"""Nodes, components, snippets, spans, Markdown and regular expressions."""

import re
import subprocess
import sys
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tests.conftest import rows_by
from webstrata.functions.htmltree import Tree, flatten
from webstrata.operators import dom, extract, markdown
from webstrata.operators import query as q
from webstrata.operators import snippets as sn
from webstrata.operators.extras import search_extras

PAGE = """<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- note one -->lost
<h1 id="top_part one">Head <em>line</em></h1>after<p class="a_b c-d - e">x <b>y</b> z<p>second<ul><li>1<li>2<ul><li>in</ul></ul>
<img src="a&amp;b.png"><script>var a="</p><h1>no</h1>";</script>tail<table><tr><td>c1<td>c2<tr><td>c3</table></body></html>"""


def table(spark, *contents):
    rows = [(1, i, f"http://h/{i}", "html", "H: 1\r\nX: find me", c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "site long, id long, url string, type string, headers string, content string")


def test_tree_structure(spark):
    shredded = dom.shred_html(table(spark, PAGE, "", None, "plain text", "<div>a<div>b</div>")).cache()
    nodes = [r for r in dom.nodes(shredded).collect() if r.id == 0]
    by_tag = {}
    for n in nodes:
        by_tag.setdefault(n.tag, []).append(n)
    assert [n.path for n in by_tag["p"]] == ["/html/body/p"] * 2
    assert [n.path for n in by_tag["li"]] == ["/html/body/ul/li", "/html/body/ul/li", "/html/body/ul/li/ul/li"]
    assert [n.path for n in by_tag["td"]] == ["/html/body/table/tr/td"] * 3 and len(by_tag["tr"]) == 2
    assert len(by_tag["h1"]) == 1 and by_tag["h1"][0].attrs == {"id": "top_part one"}
    assert by_tag["script"][0].text.count("</p>") == 1 and by_tag["script"][0].tail == "tail"
    assert by_tag["img"][0].attrs["src"] == "a&b.png"
    assert [(n.kind, n.text) for n in nodes if n.kind == "comment"] == [("comment", " note one ")]
    assert by_tag["body"][0].last == max(n.node for n in nodes)
    counts = rows_by(dom.count_nodes(shredded, "h1"), "id")
    assert {i: r.n for i, r in counts.items()} == {0: 1, 1: 0, 3: 0, 4: 0}


def test_selectors(spark):
    shredded = dom.shred_html(table(spark, PAGE))

    def values(**how):
        return [r.value for r in dom.select_nodes(shredded, **how).orderBy("node").collect()]

    assert values(tag="h1", tail=False) == ['<h1 id="top_part one">Head <em>line</em></h1>']
    assert values(tag="h1") == ['<h1 id="top_part one">Head <em>line</em></h1>after']
    assert values(tag="h1", text=True) == ["Head"]
    assert values(tag="img", attr="src") == ["a&b.png"] and values(attr="lang") == ["en"]
    assert values(path="/ul/li/ul/li$", text=True) == ["in"] == values(tag="li", text=True)[2:]
    assert values(equals={"id": "top_part one"}, text=True) == ["Head"] and values(equals={"id": "x"}) == []


def test_components(spark):
    got = rows_by(dom.page_components(table(spark, PAGE, None, "just text\n here", "lead <i>x</i> end", "a" * (2 ** 21 + 1))), "id")
    page = got[0]
    assert page.text == "A & B lost Head after line x y z second 1 2 in tail c1 c2 c3"
    assert page.attributes == "en top part one a b c-d e a&b.png"
    assert page.comments == "note one" and page.headers == "H: 1 X: find me"
    assert page.markup.split() == ["html", "lang", "head", "title", "style", "body", "h1", "id", "em", "p", "class", "b", "p", "ul",
                                   "li", "li", "ul", "li", "img", "src", "script", "table", "tr", "td", "td", "tr", "td"]
    assert (got[1].text, got[2].text, got[3].text, got[4].text) == ("", "just text here", "lead x end", "a" * (2 ** 21 + 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "text ",
                                 "&amp;", "<!-- c -->", "<br>", "<div class='a'>", "</div>", "<", ">", "<script>", "</script>", "<?x>"]),
                max_size=30))
def test_any_markup_makes_a_tree(parts):
    source = "".join(parts)
    flat = flatten(source)
    for n in flat["nodes"]:
        assert n["parent"] < n["node"] <= n["last"] < len(flat["nodes"])
        assert 0 <= n["start"] <= n["stop"] <= n["tail_stop"] <= len(flat["html"])
        if n["kind"] == "element":
            assert flat["html"][n["start"]:].startswith("<" + n["tag"])
        if n["parent"] >= 0:
            parent = flat["nodes"][n["parent"]]
            assert parent["start"] < n["start"] and n["tail_stop"] <= parent["stop"] and n["depth"] == parent["depth"] + 1
    tree = Tree(source)
    visible = flat["lead"] + "".join(n["text"] + n["tail"] if n["kind"] == "element" else n["tail"] for n in flat["nodes"])
    assert sorted(tree.string(tree.root)) == sorted(visible)
    markdown.markdown_text(source)


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<h1>", "<script ", "<a href=", "<div>", "</p>", "<b>x</i>", "<ul><li>", "<a b='", "<br>t "])
def test_costly_pages_stay_cheap(piece):
    started = time.perf_counter()
    flat = flatten(piece * 20_000)
    markdown.markdown_text(piece * 20_000)
    assert time.perf_counter() - started < 20 and len(flat["nodes"]) <= 40_000


@pytest.mark.parametrize("source, attrs", [
    ("<a B=1 c='x y' d=\"&lt;b>\" e>", {"b": "1", "c": "x y", "d": "<b>", "e": ""}), ("<a href=/x/>t", {"href": "/x/"}),
    ("<a t='1 < 2' u=\"<i>\">", {"t": "1 < 2", "u": "<i>"}), ("<a b='c>d", {"b": "'c"}), ("<a x = 'y' x=z/>", {"x": "y"}), ("<a", {})])
def test_attributes(source, attrs):
    assert dict(flatten(source)["nodes"][0]["attrs"]) == attrs


def _searched(spark, *contents):
    return table(spark, *contents).withColumn("status", F.lit(200))


def test_snippets(spark):
    body = "<html><body><p>" + " ".join(f"word{i}" for i in range(30)) + " target phrase here " + " ".join(
        f"more{i}" for i in range(30)) + "</p><p class='target'>x</p><!-- a target --></body></html>"
    rows = _searched(spark, body, "<p>nothing</p>", "<p>find</p>" * 2)
    wanted = q.text("target") | q.field("content", "find")
    got = rows_by(sn.snippets(rows, wanted), "id")
    assert set(got) == {0, 2}
    first = got[0].snippet.split(" ... ")
    assert first[0] == " ".join(f"word{i}" for i in range(22, 30)) + " **target** phrase here " + " ".join(f"more{i}" for i in range(6))
    assert first[1:3] == ["**target**", "a **target**"] and got[2].snippet.startswith("**find** **find**")
    rows_of = sorted((r.id, r.part, r.word, r.excerpt) for r in sn.excerpts(rows, wanted).collect())
    assert (0, "text", 31, first[0]) in rows_of and (0, "attributes", 1, "**target**") in rows_of and (0, "comments", 2, "a **target**") in rows_of


def test_every_excerpt_comes_back(spark):
    rows = _searched(spark, " ".join(f"aa{i} hit bb{i} " + "z " * 60 for i in range(40)))
    found = sn.excerpts(rows, q.field("content", "hit"))
    assert found.where("part = 'text'").count() == 40 and sn.snippets(rows, q.field("content", "hit"), shown=2).first().snippet.endswith("+38 more")


@pytest.mark.parametrize("text, terms, marked", [
    ("a hit b hit", ["hit"], ["a **hit** b **hit**"]), ("hits only", ["hit"], []), ("big red car", ["red", "big red"], ["**big red** car"]),
    (", [a] HIT!", ["hit"], [", [a] **HIT**!"]), ("hit-and-run é-Hit chit", ["hit"], ["**hit**-and-run é-**Hit** chit"]),
    ("a.b aXb", ["a.b"], ["**a.b** aXb"])])
def test_marks(spark, text, terms, marked):
    found = sn._found(spark.createDataFrame([(1, text)], "id int, text string"), terms, 8)
    assert [e.excerpt for r in found.collect() for e in r.excerpts or []] == marked


def test_long_and_deep_pages_are_whole(spark):
    long = "<html><body><p>" + "x " * 1_100_000 + "</p><p title='" + "<" * 30_000 + "'>needle</p></body></html>"
    deep = "<div>" * 1_000 + "needle" + "</div>" * 1_000
    rows = _searched(spark, long, deep)
    parts = rows_by(dom.page_components(rows), "id")
    assert parts[0].text.endswith("x needle") and parts[1].text == "needle"
    assert {r.id: r.snippet for r in sn.snippets(rows, q.field("content", "needle")).collect()}[1] == "**needle**"
    texts = dom.select_nodes(dom.shred_html(rows, paths=False), "p", text=True).where("id = 0").collect()
    assert texts[-1].value == "needle"
    assert dom.select_nodes(dom.shred_html(rows.where("id = 1")), "div", text=True).first().value == "needle"


def test_rejected_patterns_are_named(spark):
    rows = _searched(spark, "<p>aab</p>")
    with pytest.raises(ValueError, match="a\\+b\\+"):
        extract.extract_regex(rows, ["(a+b+)"])
    tables, rejected = search_extras(rows, q.field("content", "aab"), ["regex"], ["(a+b+)", "a+b"])
    assert rejected == ["(a+b+)"] and [r.value for r in tables["regex"].collect()] == ["aab"]
    assert extract.extract_regex_values(rows, []).count() == 0


def test_highlights(spark):
    df = spark.createDataFrame([(1, "Car CAR scar big  red, big red é-car"), (2, None), (3, "catcar")], "id int, t string")
    got = [tuple(r) for r in sn.highlight_spans(df, "t", ["car", "big red", "big"], ["id"]).orderBy("id", "start").collect()]
    assert got == [(1, 0, 3, "Car"), (1, 4, 7, "CAR"), (1, 13, 16, "big"), (1, 23, 30, "big red"), (1, 33, 36, "car")]
    assert sn.highlight_spans(df, "t", [], ["id"]).count() == 0
    # terms are independent, rows too, also under one key
    df = spark.createDataFrame([(1, "privacy policy update"), (1, "aa the bb"), (1, "the-The, the privacy policy")], "id int, t string")
    got = sorted(tuple(r) for r in sn.highlight_spans(df, "t", ["privacy policy", "policy update", "the", "THE"], ["id"]).collect())
    assert got == [(1, 0, 3, "the"), (1, 0, 21, "privacy policy update"), (1, 3, 6, "the"), (1, 4, 7, "The"), (1, 9, 12, "the"), (1, 13, 27, "privacy policy")]
    assert "Window" not in sn.highlight_spans(df, "t", ["the"], ["id"])._jdf.queryExecution().optimizedPlan().toString()


def test_many_highlights_in_one_text(spark):
    df = spark.createDataFrame([("the x " * 20_000,)], "t string")
    got = sn.highlight_spans(df, "t", ["the", "the x"], []).agg(F.count("*"), F.max("start"), F.max("stop")).first()
    assert tuple(got) == (20_000, 119_994, 119_999)


@pytest.mark.parametrize("values", [[], [3], [1, 2, 3, 4, 5], [5, 1, 4, 9, 2, 9, 1] * 9])
def test_running_totals(spark, values):
    from itertools import accumulate
    from webstrata.functions.text import running
    row = spark.createDataFrame([(values,)], "v array<int>").select(running("v", lambda a, b: a + b).alias("s"), running("v", F.greatest).alias("m")).first()
    assert row.s == list(accumulate(values)) and row.m == list(accumulate(values, max))


def test_repeated_captures_keep_their_own_snippets(spark):
    rows = _searched(spark, "<p>a needle here</p>", "<p>none</p>", "<p>needle two</p>")
    tripled = rows.union(rows).union(rows).withColumn("site", F.lit(1)).withColumn("id", F.lit(1))
    got = sn.snippets(tripled, q.field("content", "needle")).collect()
    assert sorted(r.snippet for r in got) == ["**needle** two"] * 3 + ["a **needle** here"] * 3
    assert sn.excerpts(tripled, q.field("content", "needle")).count() == 6


def test_markers(spark):
    df = spark.createDataFrame([("a **b c** d  **e-f** **1**",), ("none",), ("**x**",), ("**können** **404**",)], "s string")
    got = df.select(sn.strip_markers(F.col("s")).alias("t"), sn.marked_spans(F.col("s")).alias("m")).collect()
    assert [(r.t, [r.t[m.start:m.stop] for m in r.m]) for r in got] == [("a b c d e-f 1", ["b c", "e-f", "1"]), ("none", []), ("x", ["x"]),
                                                                                    ("können 404", ["können", "404"])]


MD = """<html><head><title>No</title><style>p{}</style></head><body>
<h1>First  heading</h1><p>Some text, <strong>strong words</strong>. Then <b>bold</b> and <em>soft</em> or <i>slanted</i>, and
<a href="#part">a part</a> of it, <a href="/next"> the next </a> one, <a href="/none"></a><del>gone</del>.</p>
<h2>Two</h2><h3>Three</h3><h4>Four</h4><h5>Five</h5><h6>Six</h6><h2>  </h2><hr>
<ul><li>one</li><li>two<ul><li>nested</li></ul></li><li></li></ul><ol><li>first</li><li> </li><li>second</li></ol>
<dl><dt>Term</dt><dd>Its meaning</dd></dl>
<table><thead><tr><th>H1</th><th>H2</th></tr></thead><tbody><tr><td>c <b>1</b></td><td></td></tr></tbody></table>
<table><tr><td>only</td></tr></table><p>Use <code>x  = 1</code> here<br>now</p>
<pre><code class="language-py">def f():
    return 1</code></pre><blockquote><p>"Said
so"</p></blockquote><img src="i.png"><form><input></form><div>outer<div>inner</div></div><nav>menu</nav></body></html>"""


def test_markdown():
    text = markdown.markdown_text(MD)
    for part in ("# First heading\n", "## Two\n", "### Three", "#### Four", "##### Five", "###### Six", "\n---\n",
                 "text, **strong words**. Then **bold** and *soft* or *slanted*, and", "a part of it, [the next](/next) one,",
                 "~~gone~~", "* one\n* two\n    * nested", "1. first", "2. second", "**Term**\n    Its meaning",
                 "| H1 | H2 |\n|---|---|\n| c **1** |   |", "|   |\n|---|\n| only |", "Use `x  = 1` here  \nnow",
                 "```py\ndef f():\n    return 1\n```", '> "Said so"', "outer", "inner", "menu"):
        assert part in text, part
    for part in ("p{}", "No", "i.png", "**  ", "  **", "/none", "\n\n\n"):
        assert part not in text, part
    assert len(re.findall(r"^#{1,6} ", text, re.MULTILINE)) == 6


def test_markdown_edges(spark):
    assert markdown.markdown_text("no markup") is None and markdown.markdown_text(None) is None
    assert markdown.markdown_text("<p>a</p>") == "a"
    deep = "<i>" * 3000 + "x"
    assert markdown.markdown_text(deep).strip("*") == "x"
    got = markdown.markdown_savings(table(spark, MD, "<p>x</p>", "plain")).first()
    assert (got.pages, got.html_bytes) == (3, len(MD) + 8 + 5) and 0 < got.markdown_bytes < got.html_bytes


def test_regex(spark):
    rows = table(spark, "a1 b22 a333", None)
    got = [(r.id, r.selector, r.source, r.value, r.groups, r.start, r.stop)
           for r in extract.extract_regex(rows, [r"(a)?(\d+)", "H: "]).orderBy("id", "pos").collect()]
    assert got == [
        (0, r"(a)?(\d+)", "headers", "1", {2: "1"}, 3, 4), (0, r"(a)?(\d+)", "content", "a1", {1: "a", 2: "1"}, 0, 2),
        (0, r"(a)?(\d+)", "content", "22", {2: "22"}, 4, 6), (0, r"(a)?(\d+)", "content", "a333", {1: "a", 2: "333"}, 7, 11),
        (0, "H: ", "headers", "H: ", {}, 0, 3), (1, r"(a)?(\d+)", "headers", "1", {2: "1"}, 3, 4), (1, "H: ", "headers", "H: ", {}, 0, 3)]
    native = {(r.id, r.selector, r.source, r.n, r.value, tuple(sorted(r.groups.items())))
              for r in extract.extract_regex_values(rows, [r"(a)?(\d+)", "H: "]).collect()}
    assert len(native) == 7 and (0, r"(a)?(\d+)", "content", 1, "22", ((2, "22"),)) in native


@pytest.mark.parametrize("bad", ["(a*b+)", "(a+b+)", "(a+b*)", "(a*b*)", ".*x.*", ".+x.+", "(a?)*", "(a?)+", "(a?b?)+"])
def test_hazards(bad):
    assert extract.is_hazardous(bad) and extract.usable_patterns([bad]) == []


def test_extras():
    assert extract.usable_patterns(["a+", "(", r"h1>([^<]*)"]) == ["a+", r"h1>([^<]*)"]
    assert extract.requested_extras(["Markdown", "nope"]) == (["markdown"], ["nope"])
    assert extract.needed_columns(["markdown"]) == ["content"] and extract.needed_columns(["regex", "xpath"]) == ["content", "headers"]


def test_search_with_extras(spark):
    rows = table(spark, PAGE, "<p>other</p>").withColumn("status", F.lit(200))
    tables, rejected = search_extras(rows, q.field("content", "second"), ["Markdown", "snippets", "regex", "xpath", "thumbs"],
                                     patterns=["sec[a-z]+"], selectors=[{"tag": "b", "text": True}, {"tag": "img", "attr": "src"}])
    assert rejected == ["thumbs"] and set(tables) == {"markdown", "snippets", "regex", "xpath"}
    assert [r.id for r in tables["markdown"].collect()] == [0] and "**second**" in tables["snippets"].first().snippet
    assert tables["regex"].first().value == "second"
    assert [(r.selector, r.value) for r in tables["xpath"].orderBy("selector").collect()] == [(0, "y"), (1, "a&b.png")]


def test_task_functions_need_no_installed_package():
    code = "import pickle, sys; print(pickle.loads(sys.stdin.buffer.read())('<h1>x</h1>'))"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(markdown.markdown_text), capture_output=True, cwd="/",
                          env={"PATH": "/usr/bin"}, timeout=60)
    assert done.stdout.strip() == b"# x", done.stderr


def test_tests_of_attributes_and_sums(spark):
    page = "<p class='x y' data-n='3'>4</p><p data-n=' 2.5 '>x</p><p>7 apples</p><p data-n=''></p><div class=z>1</div>"
    shredded = dom.shred_html(table(spark, page, "<p>none</p>"))
    n = lambda **how: [r.n for r in dom.count_nodes(shredded, **how).orderBy("id").collect()]
    assert n(tag="p", missing=["class"]) == [3, 1] and n(tag="p", contains={"class": "y"}) == [1, 0] and n(attr="data-n", missing=["class"]) == [2, 0]
    assert n(equals={"class": "z"}) == [1, 0]
    total = lambda **how: [(r.total, r.without_number) for r in dom.sum_nodes(shredded, **how).orderBy("id").collect()]
    assert total(tag="p", attr="data-n") == [(5.5, 2), (0.0, 1)] and total(tag="p", pattern="([0-9]+)") == [(11.0, 2), (0.0, 1)]
    assert [r.value for r in dom.select_nodes(shredded, "p", attr="data-n", missing=["class"]).orderBy("node").collect()] == ["2.5", ""]


def test_a_batch_of_pages_is_parsed_in_bounded_pieces():
    page = "<p>" + "<i>x</i>" * 50_000 + "</p>"
    pages = pa.array([page, None, "", "<b>y</b>"] * 6 + [None])
    pieces = list(dom.parsed(iter([pages, pages.slice(0, 0)]), False))
    assert [len(p) for p in pieces[-1:]] == [0] and sum(map(len, pieces)) == len(pages)
    assert len(pieces) >= 3 and max(len([x for x in p.field("html") if len(x.as_py() or "") > 1000]) for p in pieces) <= 3
    whole = pa.concat_arrays(pieces)
    assert [x.is_valid for x in whole][:4] == [True, False, False, True] and [len(x) for x in whole.field("nodes").to_pylist()[:4:3]] == [50_001, 1]

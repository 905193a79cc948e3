"""Audits on pages written here, where every finding is known."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_by
from webstrata.functions import scalar as N
from webstrata.operators import groups
from webstrata.plans import errors, facts, files, perf, seo

DESCRIPTION = "d" * 130
HOME = f"""<!DOCTYPE html><html lang="en"><head><title>The home page of this very site</title>
<meta name="description" content="{DESCRIPTION}"><meta content='w' name='viewport'><meta property="og:title" content="t">
<link rel="canonical" href="https://ex.com/"><link rel="stylesheet" href="/css/site.css"><style>@import url(x.css); p{{color:red !important}}</style>
<script src="/js/app.js"></script><script async src="https://cdn.jsdelivr.net/lib.js"></script><script src="/js/b.js" defer></script>
<script>jQuery("#a"); document.getElementById("x")</script><script type="application/ld+json">{{}}</script></head>
<body><h1>Welcome</h1><h3>Skipped</h3><h2>Two</h2><img src="/i/a.png" alt="a"><img src="i/b.png">
<a href="about/">About</a><a href='/gone?x=1#frag'>Gone</a><a href="#top">Top</a><a href="//other.org/p">Other</a><a href=mailto:x@y.z>Mail</a>
<!-- <a href="/commented">c</a> --></body></html>"""
ABOUT = """<html><head><title>Same</title></head><body><h1>One</h1><h1>Two</h1><h1>%s</h1>
<a href="../">Home</a><a href="./more.html">More</a><a href="/gone?x=1">Gone</a><link rel=stylesheet href="/css/site.css"></body></html>""" % ("x" * 71)
PLAIN = "<html><head><title>Same</title></head><body><h2>No first</h2></body></html>"
ROWS = [("https://ex.com/", "html", 200, 4000, HOME), ("https://ex.com/about/", "html", 200, 900, ABOUT),
        ("https://ex.com/about/more.html", "html", 500, 100, PLAIN), ("https://ex.com/p/7/", "html", 200, 100, PLAIN),
        ("https://ex.com/css/site.css", "style", 200, 250 * 1024, "@import 'a'; a{-webkit-x:1}"),
        ("https://ex.com/js/app.js", "script", 200, 120 * 1024, "$(1)"), ("https://ex.com/js/b.js", "script", 404, 10, ""),
        ("https://cdn.jsdelivr.net/lib.js", "script", 200, 600 * 1024, "x"), ("https://ex.com/i/a.png", "img", 200, 3 << 20, None),
        ("https://static.ex.com/lost.gif?v=2", "img", 200, 10, None), ("http://ex.com/list?page=9", "html", 404, 0, None),
        ("https://ex.com/api/x", "other", 404, 0, None), ("https://ex.com/images/y", "other", 404, 0, None)]


@pytest.fixture(scope="module")
def crawl(spark):
    df = spark.createDataFrame(ROWS, "url string, type string, status int, size long, content string")
    return df.select(N.resource_id(F.lit("ex.com")).alias("site"), N.resource_id(F.col("url")).alias("id"), "*",
                     F.to_timestamp(F.lit("2024-05-01")).alias("modified")).cache()


@pytest.fixture(scope="module")
def page_facts(crawl):
    return facts.page_facts(crawl).cache()


@pytest.fixture(scope="module")
def links(crawl):
    return facts.link_table(crawl).cache()


def test_links(links):
    home = [(r.tag, r.href, r.internal) for r in links.where("url = 'https://ex.com/'").orderBy("pos").collect()]
    assert home == [
        ("link", "https://ex.com/", True), ("link", "https://ex.com/css/site.css", True), ("script", "https://ex.com/js/app.js", True),
        ("script", "https://cdn.jsdelivr.net/lib.js", False), ("script", "https://ex.com/js/b.js", True),
        ("img", "https://ex.com/i/a.png", True), ("img", "https://ex.com/i/b.png", True), ("a", "https://ex.com/about/", True),
        ("a", "https://ex.com/gone?x=1", True), ("a", "https://ex.com/", True), ("a", "https://other.org/p", False),
        ("a", "mailto:x@y.z", False)]
    assert [r.href for r in links.where("url like '%about/'").orderBy("pos").collect()] == [
        "https://ex.com/", "https://ex.com/about/more.html", "https://ex.com/gone?x=1", "https://ex.com/css/site.css"]


@pytest.mark.parametrize("base, ref, expected", [
    ("http://h/a/b/c?q#f", "d", "http://h/a/b/d"), ("http://h/a/b/c", "../d", "http://h/a/d"), ("http://h/a", "../../d", "http://h/d"),
    ("http://h", "d", "http://h/d"), ("http://h/a/", "./", "http://h/a/"), ("http://h/a/b/", "..", "http://h/a/"),
    ("http://h/a?x", "?y=1", "http://h/a?y=1"), ("http://h/a", "", "http://h/a"), ("https://h/a", "//o/x/../y", "https://o/x/../y"),
    ("http://h/a", "/x/./y/../z?p=..#q", "http://h/x/z?p=.."), ("http://h/a", " HTTPS://O/x ", "HTTPS://O/x"), ("http://h/", "/..", "http://h/"),
    ("http://h/a#x", "#y", "http://h/a")])
def test_resolution(spark, base, ref, expected):
    df = spark.createDataFrame([(base, ref)], "b string, r string")
    assert df.select(N.resolve_url(F.col("b"), F.col("r"))).first()[0] == expected


def test_broken_and_orphans(crawl, links):
    broken = perf.broken_links(links, crawl)
    assert {r.href: (r.status, r.pages, r.refs) for r in broken.collect()} == {
        "https://ex.com/gone?x=1": (None, 2, 2), "https://ex.com/i/b.png": (None, 1, 1), "https://ex.com/js/b.js": (404, 1, 1),
        "https://ex.com/about/more.html": (500, 1, 1)}
    assert perf.broken_link_referrers(links, broken).count() == 5
    assert {r.url for r in files.orphan_assets(crawl, links).collect()} == {
        "https://static.ex.com/lost.gif?v=2", "https://ex.com/api/x", "https://ex.com/images/y"}


def test_shared_assets(links):
    assert {r.href[-8:]: (r.pages, r.scope) for r in perf.shared_assets(links).collect()} == {
        "site.css": (2, "global"), "s/app.js": (1, "homepage"), "t/lib.js": (1, "homepage"), ".com/js/b.js"[-8:]: (1, "homepage"),
        ".com/i/a.png"[-8:]: (1, "homepage"), ".com/i/b.png"[-8:]: (1, "homepage")}


def test_titles_and_meta(page_facts):
    titles = rows_by(seo.title_audit(page_facts), "url")
    assert [(titles[u].verdict, titles[u].pages_with_title) for u in ("https://ex.com/", "https://ex.com/about/")] == [("optimal", 1), ("short", 3)]
    assert {r.verdict: (r.pages, r.duplicated) for r in seo.title_summary(page_facts).collect()} == {"optimal": (1, 0), "short": (3, 3)}
    meta = rows_by(seo.meta_audit(page_facts), "url")
    home = meta["https://ex.com/"]
    assert (home.verdict, home.has_canonical, home.has_og_title, home.has_og_image, home.has_viewport, home.has_lang, home.has_json_ld) == (
        "optimal", True, True, False, True, True, True)
    assert (meta["https://ex.com/about/"].verdict, meta["https://ex.com/about/"].pages_with_description) == ("missing", 1)


def test_headings(page_facts):
    got = {r.url[15:]: (r.headings, r.h1_verdict, r.breaks, r.h1_too_long) for r in seo.heading_audit(page_facts).collect()}
    assert got == {"": (3, "single", 1, False), "about/": (3, "multiple", 0, True), "about/more.html": (1, "missing", 0, False),
                   "p/7/": (1, "missing", 0, False)}


def test_quality_and_scorecard(page_facts, crawl):
    quality = {r.url[15:]: (r.images, r.images_without_alt, r.pages_with_text) for r in seo.content_quality(page_facts).collect()}
    assert quality == {"": (2, 1, 1), "about/": (0, 0, 1), "about/more.html": (0, 0, 2), "p/7/": (0, 0, 2)}
    card = rows_by(seo.page_scorecard(page_facts), "url")
    assert (card["https://ex.com/"].high, card["https://ex.com/"].medium, card["https://ex.com/"].low) == (1, 1, 0)
    assert card["https://ex.com/about/"].high == 4 and card["https://ex.com/about/"].h1_too_long
    matrix = rows_by(seo.issue_matrix(seo.page_scorecard(page_facts)), "template")
    assert matrix["/p/{n}/"].title_duplicate == 1 and matrix["/"].alt_missing == 1
    density = rows_by(seo.keyword_density(crawl, "Two"), "url")["https://ex.com/"]
    assert (density.hits, density.band) == (1, "stuffed")


def test_render_path(crawl):
    got = rows_by(perf.render_blockers(crawl), "url")["https://ex.com/"]
    assert (got.stylesheets, got.scripts, got.blocking_scripts, got.inline_styles, got.inline_scripts, got.blockers) == (1, 3, 1, 1, 2, 2)
    totals = {r.metric: (r.value, r.ok) for r in perf.performance_totals(crawl, perf.render_blockers(crawl)).collect()}
    assert totals == {"css_bytes": (250 * 1024, False), "js_bytes": (720 * 1024 + 10, False), "asset_hosts": (2, True), "blockers": (2, True)}
    hits = {(r.pattern, r.type): (r.occurrences, r.files) for r in perf.anti_patterns(crawl).collect()}
    assert hits[("css import", "html")] == (1, 1) and hits[("css import", "style")] == (1, 1) and hits[("jquery", "script")] == (1, 1)
    assert hits[("vendor prefix", "style")] == (1, 1) and hits[("getElementById", "html")] == (1, 1) and hits[("important", "html")] == (1, 1)


def test_errors(crawl):
    total = [r for r in errors.status_summary(crawl).collect() if r.site is None][0]
    assert (total.pages, total.not_found, total.server_errors, total.grade) == (5, 4, 1, "F")
    assert {r.pattern: r.n for r in errors.error_patterns(crawl).collect()} == {"pagination": 1, "api": 1, "media": 1, "other": 1}
    assert {r.host: (r.relation, r.not_found) for r in errors.domain_breakdown(crawl, "ex.com").collect()} == {
        "ex.com": ("main", 4), "cdn.jsdelivr.net": ("external", 0), "static.ex.com": ("subdomain", 0)}
    assert {r.on_site: r.n for r in errors.errors_on_off_site(crawl, "ex.com").collect()} == {True: 4}


def test_files(crawl):
    hosts = rows_by(files.asset_hosts(crawl, "ex.com"), "host")
    assert {h: (r["class"], r.score) for h, r in hosts.items()} == {
        "ex.com": ("main", 1), "cdn.jsdelivr.net": ("third-party cdn", 3), "static.ex.com": ("asset subdomain", 3)}
    assert files.best_asset_host(crawl, "ex.com").first().score == 3
    assert {(r.url[-7:], r.tier) for r in files.oversized(crawl).collect()} == {
        ("ite.css", "oversized"), ("/app.js", "large"), ("/lib.js", "oversized"), ("i/a.png", "oversized")}
    assert {(r.extension, r.n) for r in files.format_mix(crawl).collect()} == {(".png", 1), (".gif", 1)}
    assert {r.url for r in files.image_urls(crawl).collect()} == {"https://ex.com/i/a.png", "https://static.ex.com/lost.gif"}
    assert {(r.directory, r.n) for r in files.directories(crawl, 2).collect()} >= {("about/more.html", 1), ("p/7", 1), ("/", 1)}
    sample = files.template_sample(crawl, 1).collect()
    assert {(r.template, r.pages) for r in sample} == {("/", 1), ("/about/", 1), ("/about/more.html", 1), ("/p/{n}/", 1), ("/list", 1)}


def test_freshness(spark):
    df = spark.createDataFrame([("html", "2024-01-01"), ("html", "2024-06-30"), ("html", "2024-12-31"), ("img", "2030-01-01")], "type string, d string")
    got = files.freshness(df.withColumn("modified", F.to_timestamp("d"))).first()
    assert (got.pages, got.fresh, got.newest) == (3, 2, "2024-12-31")


def test_exact_quantiles_over_many_partitions(spark):
    import random
    rng = random.Random(4)
    rows = [(rng.choice(["html", "img", None]), rng.choice([None, rng.randint(0, 50), rng.randint(0, 10**6)])) for _ in range(3000)] + [("one", 7), ("none", None)]
    got = {r.type: (r.n, r.median, r.p90) for r in files.size_stats(spark.createDataFrame(rows, "type string, size long")).collect()}
    for kind in {t for t, _ in rows}:
        known = sorted(s for t, s in rows if t == kind and s is not None)
        rank = lambda q: known[-(-len(known) * q // 10) - 1] if known else None
        assert got[kind] == (sum(t == kind for t, _ in rows), rank(5), rank(9))


def test_group_helpers_on_a_hot_key(spark):
    df = spark.range(9000).select(F.lit(1).alias("site"), "id", F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 1000 != 1, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("title"))
    sized = groups.with_group_size(df, ["title"], ["site", "id"], "n")
    got = {r.n: r["count"] for r in sized.groupBy("n").count().collect()}
    assert got == {3000: 3000, 1: 6000}
    nulls = groups.with_group_size(df.withColumn("title", F.when(F.col("id") < 3, F.col("title"))), ["title"], ["site", "id"], "n")
    assert nulls.count() == 9000 and nulls.agg(F.max("n")).first()[0] == 1 and nulls.columns == ["site", "id", "title", "n"]
    plan = sized._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "_salt" not in plan
    newest = groups.latest_by(df.withColumn("x", F.col("id") % 7), ["title"], [F.col("x"), -F.col("id")])
    hot = newest.where("title = 'hot'").first()
    assert (hot.x, hot.id) == (6, 6) and newest.count() == df.select("title").distinct().count()
    assert [tuple(r) for r in groups.duplicates(df.where("title is not null"), ["title"]).collect()] == [("hot", 3000)]


def test_template_sample_on_a_hot_template(spark):
    df = spark.range(5000).select(F.lit(1).alias("site"), "id", F.format_string("http://h/p/%05d", "id").alias("url"), F.lit("html").alias("type"))
    got = files.template_sample(df, 3).orderBy("rank").collect()
    assert [(r.template, r.pages, r.rank, r.id) for r in got] == [("/p/{n}", 5000, i + 1, i) for i in range(3)]


def test_pages_that_close_nothing(spark):
    """Patterns stay linear on pages of many open elements."""
    bodies = [t * 60_000 for t in ("<script>", "<style>", "<!--", "<h1>", "<title>", "<script ", "<a href=", "< a")]
    df = spark.createDataFrame([(1, i, f"http://h/{i}", "html", 200, 1, b) for i, b in enumerate(bodies)],
                               "site long, id long, url string, type string, status int, size long, content string")
    got = {r.id: r.words for r in facts.page_facts(df).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[7] == 60_000
    assert facts.link_table(df).count() <= 1 and perf.render_blockers(df).count() == 8


def test_base_and_srcset(spark):
    pages = [(1, 1, "https://a.com/d/x", "html", """<base href="https://b.com/z/"><a href="y">1</a><img src="p.png" srcset="q.png 1x, /r.png 2x">"""),
             (1, 2, "https://a.com/d/x2", "html", """<script>"<base href='no'>"</script><a href="y">2</a><img srcset='s.png 100w'>""")]
    df = spark.createDataFrame(pages, "site long, id long, url string, type string, content string")
    got = {i: [r.href for r in facts.link_table(df).where(f"id = {i}").orderBy("pos", "href").collect()] for i in (1, 2)}
    assert got == {1: ["https://b.com/z/y", "https://b.com/r.png", "https://b.com/z/p.png", "https://b.com/z/q.png"], 2: ["https://a.com/d/y", "https://a.com/d/s.png"]}

"""Result shapes, scalar rules, and the plans behind them."""

from datetime import datetime


import json

import pytest
from pyspark.sql import functions as F

from webstrata.functions import scalar as N
from webstrata.functions import text as tx
from webstrata.operators import query as q
from webstrata.operators import results as R
from webstrata.sources import load_resources, write_resources


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, make, *values):
    return spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))]).select(
        make(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.fixture(scope="module")
def stored(spark, pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "t")
    write_resources(pages, path)
    return load_resources(spark, path)


def test_fields():
    assert R.fields() == ["id", "url", "site", "type", "status"]
    assert R.fields(["content", "size", "nope", "url"]) == ["id", "url", "site", "type", "status", "size", "content"]


def test_order_and_pages(pages):
    urls = [r.url for r in R.search_page(pages, q.match_all(), limit=100).collect()]
    assert urls == sorted(urls) and len(urls) == q.search(pages, q.match_all()).count()
    assert [r.url for r in R.search_page(pages, q.match_all(), limit=5, offset=5).collect()] == urls[5:10]
    assert [r.url for r in R.search_page(pages, q.match_all(), sort="-url", limit=3).collect()] == urls[::-1][:3]
    sizes = [r.size for r in R.search_page(pages, q.match_all(), ["size"], "'-size'", 7).collect()]
    assert sizes == sorted(sizes, reverse=True)
    assert R.search_page(pages, q.match_all(), sort="bogus", limit=0).count() == 1
    assert R.search_page(pages, q.match_all(), limit=1000, offset=-4).count() == len(urls)
    assert R.search_page(pages, q.match_all(), offset=1000).count() == 0


def test_random_page(pages):
    hits = {r.id for r in q.search(pages, q.field("type", "html")).collect()}
    drawn = [r.id for r in R.search_page(pages, q.field("type", "html"), sort="?", limit=10, seed=3).collect()]
    assert len(set(drawn)) == 10 and set(drawn) <= hits
    assert {r.type for r in R.sample_by_type(pages, {"html": 1.0, "img": 0.0}, 1).collect()} == {"html"}


def test_totals(pages):
    n = q.search(pages, q.text("and")).count()
    row = R.navigation(pages, q.text("and"), 10, 10).first()
    assert (row.total, row.page, row.pages, row.has_previous, row.has_next) == (n, 2, -(-n // 10), True, n > 20)
    assert R.total(pages, q.text("and") & ~q.text("and")).first().total == 0


def test_json(pages):
    got = {r.id: json.loads(r.json) for r in R.to_json(pages.select("id", "url", "content", "headers", "created"), ["content"]).collect()}
    images = {r.id for r in pages.where("type = 'img'").collect()}
    for i, row in got.items():
        assert (row["content"] is None) == (i in images) and row["created"].endswith("Z")
    loose = R.to_json(pages.where("type = 'img'").select("id", "content")).first().json
    assert list(json.loads(loose)) == ["id"]


def test_stored_search_reads_only_what_it_needs(stored):
    narrow = plan(R.search_page(stored, (q.status >= 400) & q.field("type", "html")))
    assert "content" not in narrow.split("ReadSchema:")[1] and "TakeOrderedAndProject" in narrow
    assert "GreaterThanOrEqual(status,400)" in narrow and "Exchange" not in narrow
    assert "content" in plan(R.search_page(stored, q.field("content", "and"))).split("ReadSchema:")[1]


def test_search_stays_in_the_jvm(stored):
    text = plan(q.search(stored, (q.text("and") | q.phrase("of the")) - q.prefix("th")))
    assert "Python" not in text and "Exchange" not in text


def test_predicates_apply_to_streams(spark, stored, pages, tmp_path):
    pages.where("type = 'html'").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    run = (q.search(stream, q.text("and")).select("id").writeStream.format("memory").queryName("hits")
           .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    run.awaitTermination()
    assert spark.table("hits").count() == q.search(pages, q.text("and") & q.field("type", "html")).count()


@pytest.mark.parametrize("path, clean, ext, kind", [
    ("/a/B.HTML", "/a/b.html", ".html", "html"), ("x/main.min.js202505251919", "x/main.min.js", ".js", "script"),
    ("x/page·12.tmp", "x/page", "", "html"), ("x/logo.png?", "x/logo.png", ".png", "img"), ("x/.htaccess", "x/.htaccess", "", "html"),
    ("x/a.tar.gz", "x/a.tar.gz", ".gz", "other"), ("x/f.docx", "x/f.docx", ".docx", "doc"), ("x.com/readme", "x.com/readme", "", "html")])
def test_file_names(spark, path, clean, ext, kind):
    assert one(spark, N.decruft_path, path) == clean
    assert one(spark, lambda c: N.extension(N.decruft_path(c)), path) == ext
    assert one(spark, lambda c: N.type_from_extension(N.extension(N.decruft_path(c))), path) == kind


@pytest.mark.parametrize("mime, kind, text", [
    ("text/html", "html", True), ("application/xhtml+xml", "html", False), ("text/javascript", "script", True),
    ("application/json", "text", True), ("Image/PNG", "img", False), ("font/woff", "other", False), ("", "other", True),
    ("application/rss+xml", "other", True), ("application/octet-stream", "other", False), ("video/mp4", "video", False)])
def test_mime(spark, mime, kind, text):
    assert (one(spark, N.type_from_mime, mime), one(spark, N.is_text, mime)) == (kind, text)


def test_small_rules(spark):
    assert one(spark, N.resource_id, "example.com") == 13928348955040
    assert one(spark, N.collapse_index, "https://h/a/index.html?x=1") == "https://h/a/?x=1"
    assert one(spark, N.collapse_index, "https://h/a/index.html/b") == "https://h/a/index.html/b"
    assert one(spark, N.type_from_log, "Redirect", ".xyz") == "html" and one(spark, N.type_from_log, "odd", ".css") == "style"
    assert one(spark, N.http_status, "HTTP/1.1 404 Not Found\r\nX: HTTP/1.1 200") == 404 and one(spark, N.http_status, "x") == 0
    assert one(spark, N.content_type, "A: b\r\ncontent-TYPE:  text/html ; charset=x\r\n") == "text/html"
    assert one(spark, N.human_bytes, 512) == "512B" and one(spark, N.human_bytes, 3328) == "3.2KB"
    assert one(spark, N.human_bytes, 5 * 1024 ** 2) == "5.0MB"
    assert one(spark, N.duration_hms, 3661.5) == "01:01:01.500"
    assert one(spark, N.display_url, "https://h/a/") == "h/a" and one(spark, N.strip_wildcards, "*'a*b\"`") == "a*b"
    assert one(spark, N.scheme, "HTTP://h") == "http" and one(spark, N.host, "mailto:x") is None
    assert one(spark, lambda c: N.path_segment(c, 2), "http://h/a/b?c/d") == "b"
    assert one(spark, tx.squash, " a \n\t b ") == "a b"
    assert one(spark, N.encode_type, "script") == 8 and one(spark, N.decode_type, 10) == "style"
    wants = [one(spark, N.wants_content, *a) for a in (("a/x.html", "html"), ("a/x.svg", "img"),
                                                       ("a/x.odd", "other"), ("a/x.swf", "other"))]
    assert wants == [True, False, True, False]


def test_times(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05.000600' AS a, timestamp'2024-01-02 03:04:05' AS b")
    assert tuple(df.select(N.iso_zulu(F.col("a")), N.iso_zulu(F.col("b"))).first()) == (
        "2024-01-02T03:04:05.000600Z", "2024-01-02T03:04:05Z")
    for given, wanted in {"2024-01-02T03:04:05.123456789Z": "2024-01-02 03:04:05.123456", "2024-01-02T05:04:05+02:00": "2024-01-02 03:04:05",
                          "": None, "nonsense": None}.items():
        assert one(spark, lambda c: N.parse_zulu(c).cast("string"), given) == wanted


def test_registry():
    import __spark_entry__ as entry
    assert len(entry.queries()) > 70 and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 8


def test_pages_of_any_size_and_keyset(pages):
    seen = pages.where("status >= 100")
    assert R.page(seen, limit=500).count() == seen.count()
    for sort in ("-size", "+id", "+status", None):
        whole = [(r.id, r.site) for r in R.page(seen, sort, 500).collect()]
        first = R.page(seen, sort, 7).collect()
        rest = R.page(seen, sort, 500, after=first[-1].asDict()).collect()
        assert [(r.id, r.site) for r in first + rest] == whole


def test_stratified_sample_is_exact_and_repeatable(spark):
    df = spark.range(6000).select((F.col("id") % 3).alias("site"), "id", F.when(F.col("id") < 5000, "html").when(F.col("id") < 5004, "img").otherwise(F.lit(None)).alias("type"))
    one, two = R.stratified_sample(df, 50, 7), R.stratified_sample(df.repartition(13), 50, 7)
    assert {r.type: r["count"] for r in one.groupBy("type").count().collect()} == {"html": 50, "img": 4, None: 50}
    assert one.columns == df.columns and one.exceptAll(two).isEmpty() and not one.exceptAll(R.stratified_sample(df, 50, 8)).isEmpty()
    assert R.stratified_sample(df, 1500, 7).where("type = 'html'").count() == 1500
    assert one._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2     # reduced before the exchange


def test_later_captures_replace_earlier_ones(spark, tmp_path):
    from webstrata.schema import RESOURCE
    from webstrata.sources import load_resources, merge_resources
    path = str(tmp_path / "t")
    row = lambda site, k, text, day: (site, k, f"u{k}", "html", 200, 1, 0, None, text, None, datetime(2024, 1, day) if day else None)
    make = lambda *rows: spark.createDataFrame(rows, RESOURCE)
    merge_resources(spark, path, make(row(1, 1, "a", 2), row(1, 2, "b", 2), row(2, 3, "c", None), row(1, 1, "older", 1)), 4)
    merge_resources(spark, path, make(row(1, 1, "new", 3), row(1, 2, "late", 1), row(2, 3, "again", None), row(5, 9, "same bucket", 1)), 4)
    got = {(r.site, r.id): r.content for r in load_resources(spark, path).collect()}
    assert got == {(1, 1): "new", (1, 2): "b", (2, 3): "again", (5, 9): "same bucket"}
    merge_resources(spark, path, make(), 4)
    assert load_resources(spark, path).count() == 4
    import glob
    import pyarrow.parquet as pq
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(1) for f in glob.glob(f"{path}/site_bucket=*/*.parquet")]
    assert columns and all(c.path_in_schema == "id" for c in columns)
    untouched = {f for f in glob.glob(f"{path}/site_bucket=2/*.parquet")}
    merge_resources(spark, path, make(row(1, 1, "newest", 9)), 4)
    assert untouched == {f for f in glob.glob(f"{path}/site_bucket=2/*.parquet")}                    # only buckets of the captures are written


def test_bloom_filters_are_written(spark, tmp_path):
    from webstrata.sources import merge_resources
    path = str(tmp_path / "t")
    merge_resources(spark, path, spark.range(500).selectExpr("1L AS site", "xxhash64(id) AS id", "concat('u', id) AS url", "'html' AS type", "200 AS status", "1L AS size", "0 AS time",
                                                            "'' AS headers", "'x' AS content", "CAST(NULL AS TIMESTAMP) AS created", "CAST(NULL AS TIMESTAMP) AS modified"), 2)
    import glob
    raw = b"".join(open(f, "rb").read() for f in glob.glob(f"{path}/*/*.parquet"))
    assert len(raw) > 2 * 100_000                                                                      # two filters sized for 100,000 values

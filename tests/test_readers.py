"""Readers on small crawl trees written here."""

import gzip
import io
import json
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_by
from webstrata import sources
from webstrata.functions import scalar
from webstrata.sources import siteone
from webstrata.sources import warc
from webstrata.sources.files import list_files, packed


def put(root, rel, body="x", when=None):
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body if isinstance(body, bytes) else body.encode())
    if when:
        os.utime(path, (when, when))
    return path


def test_listing_keeps_hidden_names(spark, tmp_path):
    for rel in ("a/_next/static/x.js", "a/.well-known/y.txt", "top.txt", "b/c/d/e/f/g.html"):
        put(tmp_path, rel)
    assert {r.rel for r in list_files(spark, str(tmp_path)).collect()} == {
        "a/_next/static/x.js", "a/.well-known/y.txt", "top.txt", "b/c/d/e/f/g.html"}


def test_wget(spark, tmp_path):
    put(tmp_path, "example.com/index.html", "<h1>home</h1>\r\nnext")
    put(tmp_path, "example.com/sub/page.html?x=1", "<p>q</p>")
    put(tmp_path, "example.com/robots.txt", "User-agent: *")
    put(tmp_path, "example.com/http-client-cache/c.html", "cached")
    put(tmp_path, "example.com/js/main.min.js123456789012", "var a")
    put(tmp_path, "example.com/_next/chunk.js", "var b")
    put(tmp_path, "example.com/logo.png", b"\x89PNG\xff")
    put(tmp_path, "example.com/odd.tmp", "odd")
    put(tmp_path, "example.com/bad.txt", b"ok \xff end")
    put(tmp_path, "example.com/big.txt", b"a" * 2_000_001)
    put(tmp_path, ".hidden/index.html", "no")
    got = rows_by(sources.read_wget(spark, str(tmp_path)), "url")
    base = "https://example.com/"
    assert set(got) == {base + p for p in ("", "sub/page.html?x=1", "js/main.min.js123456789012", "_next/chunk.js",
                                           "logo.png", "odd.tmp", "bad.txt", "big.txt")}
    home = got[base]
    assert (home.type, home.status, home.content, home.site) == ("html", 200, "<h1>home</h1>\nnext", 13928348955040)
    assert home.size == len("<h1>home</h1>\r\nnext")
    assert home.headers == f"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\nContent-Length: {home.size}\r\n\r\n"
    assert got[base + "js/main.min.js123456789012"].type == "script"
    logo = got[base + "logo.png"]
    assert (logo.type, logo.content) == ("img", None) and "image/png" in logo.headers
    assert got[base + "odd.tmp"].type == "html"
    assert got[base + "bad.txt"].content == "ok � end"
    assert (got[base + "big.txt"].content, got[base + "big.txt"].size) == ("a" * 2_000_001, 2_000_001)


def test_wget_without_content(spark, tmp_path):
    put(tmp_path, "s/a.html", "<p>")
    assert sources.read_wget(spark, str(tmp_path), content=False).first().content is None


def test_httrack(spark, tmp_path):
    log = ("HTTrack launched on Mon at https://www.example.com/ +*\n"
           "File has moved from https://www.example.com/old.html to https://www.example.com/new.html\n"
           '12:00 Warning: "Not Found" (404) at link https://www.example.com/gone.html (from x)\n'
           '12:01 Warning: "Gone" (410) at link https://www.example.com/gone.html (from x)\n')
    put(tmp_path, "proj/hts-log.txt", log)
    put(tmp_path, "proj/index.html", "project page")
    put(tmp_path, "proj/hts-cache/new.zip", "z")
    for name in ("index.html", "old.html", "gone.html", "a/b.css"):
        put(tmp_path, f"proj/example.com/{name}", "body")
    put(tmp_path, "proj/cdn.other.net/x.js", "js")
    put(tmp_path, "proj/bad_name/x.html", "u")
    put(tmp_path, "proj/nodata/readme.md", "r")
    put(tmp_path, "bare/site.org/index.html", "no log here")
    got = rows_by(sources.read_httrack(spark, str(tmp_path)), "url")
    assert {u: r.status for u, r in got.items()} == {
        "https://www.example.com/": 200, "https://www.example.com/old.html": 302, "https://www.example.com/gone.html": 410,
        "https://www.example.com/a/b.css": 200, "https://cdn.other.net/x.js": 200,
        "https://proj.local/bad_name/x.html": 200, "https://site.org/": 200}
    assert got["https://www.example.com/a/b.css"].type == "style"
    assert got["https://site.org/"].site != got["https://cdn.other.net/x.js"].site


def test_httrack_without_any_log(spark, tmp_path):
    put(tmp_path, "p/example.com/index.html", "a")
    assert sources.read_httrack(spark, str(tmp_path)).first().url == "https://example.com/"


def line(path, status, kind, time, size):
    return f"1 | 2 | 3 | {path} | {status} | {kind} | {time} | {size} | c | d\n"


def test_siteone(spark, tmp_path):
    put(tmp_path, "example.com/index.html", "<h1>home</h1>")
    put(tmp_path, "example.com/about.html", '<meta http-equiv="refresh" content="0; url=about/">')
    put(tmp_path, "example.com/about/index.html", "<h1>about</h1>")
    put(tmp_path, "example.com/app.1234abcd99.js", "js")
    put(tmp_path, "example.com/font.woff2", b"\x00")
    put(tmp_path, "example.com/unlogged.css", "css")
    old = line("/", 500, "HTML", "9 s", "1 B")
    new = (line("URL", "Status", "Type", "Time", "Size") + line("/?x=1", 200, "HTML", "120 ms", "15 kB")
           + line("/about/", 200, "HTML", "1.2 s", "2 kB") + line("/app.js", 200, "JS", "7 ms", "1 B")
           + line("/font.woff2", 200, "Font", "1 ms", "1 B") + line("/missing", 404, "Other", "30 ms", "1.5 kB")
           + line("/about.html", 503, "HTML", "30 ms", "") + "Redirected URLs\n" + line("/late", 404, "HTML", "1 ms", "1 B"))
    put(tmp_path, "output.example.com.20240101.txt", old, when=1_000_000)
    put(tmp_path, "output.example.com.20240202.txt", new, when=2_000_000)
    got = rows_by(sources.read_siteone(spark, str(tmp_path)), "url")
    base = "https://example.com/"
    assert {u[len(base):]: (r.type, r.status, r.time) for u, r in got.items()} == {
        "": ("html", 200, 120), "about/": ("html", 200, 1200), "app.js": ("script", 200, 7),
        "font.woff2": ("other", 200, 1), "unlogged.css": ("style", 200, 0), "missing": ("other", 404, 30),
        "about.html": ("other", 503, 30)}
    assert got[base + "about/"].content == "<h1>about</h1>"
    missing = got[base + "missing"]
    assert (missing.size, missing.content, missing.created) == (1536, "", None)


def test_siteone_without_log(spark, tmp_path):
    put(tmp_path, "example.com/a.html", "<p>")
    row = sources.read_siteone(spark, str(tmp_path)).first()
    assert (row.url, row.status, row.time) == ("https://example.com/a.html", 200, 0)


def test_siteone_units(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("120 ms", "15 kB"), ("1.2 s", "1 MB"), ("30", ""), ("x", "7")], "t string, s string")
    assert [tuple(r) for r in df.select(siteone.milliseconds(F.col("t")), siteone.byte_size(F.col("s"))).collect()] == [
        (120, 15360), (1200, 1048576), (30, 0), (None, 7)]


def test_katana(spark, tmp_path):
    request = "GET / HTTP/1.1\nHost: example.com"
    put(tmp_path, "example.com/aa.txt", f"https://example.com/\n\n{request}\n\nHTTP/1.1 200 OK\nContent-Type: text/html; charset=utf-8\n\n<h1>hi</h1>\n\n<p>two")
    put(tmp_path, "example.com/cdn.net/bb.txt", f"https://cdn.net/x.png\r\n\r\n{request}\r\n\r\nHTTP/2.0 404 Not Found\r\ncontent-type: image/png\r\n\r\nPNG")
    put(tmp_path, "example.com/cc.txt", f"https://example.com/c\n\n{request}\n\nHTTP/1.1 200 OK\nTransfer-Encoding: chunked\nContent-Type: text/plain\n\nf\nhello\n0 is here\n0\n")
    put(tmp_path, "example.com/ff.txt", f"https://example.com/f\r\n\r\n{request}\r\n\r\nHTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n"
        "Content-Type: text/plain\r\n\r\n6\r\nhello\n\r\n5;x=1\r\nworld\r\n0\r\n\r\n")
    put(tmp_path, "example.com/dd.txt", "https://example.com/bad\n\nonly two")
    put(tmp_path, "example.com/readme.txt", "a\n\nb\n\nc")
    put(tmp_path, "example.com/ee.txt", f"https://example.com/none\n\n{request}\n\nno status line")
    got = rows_by(sources.read_katana(spark, str(tmp_path)), "url")
    assert set(got) == {"https://example.com/", "https://cdn.net/x.png", "https://example.com/c", "https://example.com/none", "https://example.com/f"}
    home = got["https://example.com/"]
    assert (home.status, home.type, home.content) == (200, "html", "<h1>hi</h1>\n\n<p>two")
    assert home.size == len(home.content) and home.headers.startswith("HTTP/1.1 200 OK\nContent-Type")
    image = got["https://cdn.net/x.png"]
    assert (image.status, image.type, image.content) == (0, "img", None) or (image.status, image.type) == (404, "img")
    assert image.content is None and image.site == home.site
    assert got["https://example.com/c"].content == "hello\n0 is here"
    assert got["https://example.com/f"].content == "hello\nworld"
    assert (got["https://example.com/none"].status, got["https://example.com/none"].type) == (0, "other")


def record(kind, uri, block, date="2024-03-01T10:20:30Z"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Type: application/http; msgtype={kind}\r\n"
    head += f"WARC-Target-URI: {uri}\r\n" if uri else ""
    head += f"WARC-Date: {date}\r\n" if date else ""
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http(status, mime, body, extra=""):
    return f"HTTP/1.1 {status} X\r\nContent-Type: {mime}\r\n{extra}\r\n".encode() + body


def test_warc(spark, tmp_path):
    chunked = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    records = [
        record("warcinfo", None, b"software: x"), record("request", "https://e.com/", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", "https://e.com/", http(200, "text/html", "<h1>café</h1>".encode())),
        record("response", "https://e.com/a.png", http(200, "image/png", b"\x89PNG" * 10)),
        record("response", "https://e.com/bad", http(404, "text/plain", b"\xff\xfe"), "Fri, 01 Mar 2024 10:20:30 GMT"),
        record("response", "https://e.com/chunk", http(200, "text/plain", chunked, "Transfer-Encoding: chunked\r\n"), None),
        record("response", "https://e.com/gz", http(200, "text/css", gzip.compress(b"p{}"), "Content-Encoding: gzip\r\n")),
        record("response", "https://e.com/broken", b"no http here"),
        record("response", "https://e.com/last", http(301, "text/html", b"")),
    ]
    put(tmp_path, "a.warc.gz", b"".join(gzip.compress(r) for r in records))
    put(tmp_path, "b.warc", b"".join(records))
    put(tmp_path, "cut.warc", b"".join(records)[:len(b"".join(records[:3])) + 30])
    put(tmp_path, "sub/ignored.warc", records[2])
    rows = sources.read_warc(spark, str(tmp_path)).collect()
    by_site = {}
    for r in rows:
        by_site.setdefault(r.site, {})[r.url] = r
    assert sorted(len(v) for v in by_site.values()) == [1, 6, 6]
    full = [v for v in by_site.values() if len(v) == 6]
    assert [{u: r.content for u, r in v.items()} for v in full] == [{
        "https://e.com/": "<h1>café</h1>", "https://e.com/a.png": None, "https://e.com/bad": None,
        "https://e.com/chunk": "hello world", "https://e.com/gz": "p{}", "https://e.com/last": ""}] * 2
    one = full[0]
    assert (one["https://e.com/a.png"].size, one["https://e.com/a.png"].type) == (40, "img")
    assert (one["https://e.com/bad"].status, one["https://e.com/last"].status) == (404, 301)
    stamp = datetime(2024, 3, 1, 10, 20, 30, tzinfo=timezone.utc)
    assert one["https://e.com/"].created.astimezone(timezone.utc) == stamp
    assert one["https://e.com/bad"].modified.astimezone(timezone.utc) == stamp
    assert one["https://e.com/chunk"].created is None
    assert one["https://e.com/"].headers == "HTTP/1.1 200 X\r\nContent-Type: text/html\r\n"


def test_damaged_warc(spark, tmp_path):
    rng = random.Random(1)
    body = lambda: "".join(rng.choice("abcdefgh ") for _ in range(3000)).encode()
    records = [record("response", f"https://e.com/{k}", http(200, "text/html", body())) for k in range(6)]
    packed = [gzip.compress(r) for r in records]
    broken = bytearray(packed[2])
    broken[300:600] = bytes(300)
    cut = records[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    short = records[2].replace(b"Content-Length: 3", b"Content-Length: 1", 1)
    crc = packed[2][:-6] + b"\1" + packed[2][-5:]
    damaged = {"bytes.warc.gz": packed[:2] + [bytes(broken)] + packed[3:], "cut.warc.gz": packed[:2] + [packed[2][:700]] + packed[3:],
               "crc.warc.gz": packed[:2] + [crc] + packed[3:], "junk.warc.gz": packed[:2] + [b"no gzip at all" * 20] + packed[3:],
               "length.warc.gz": packed[:2] + [gzip.compress(cut)] + packed[3:], "long.warc": records[:2] + [cut] + records[3:],
               "short.warc": records[:2] + [short] + records[3:], "junk.warc": records[:2] + [b"junk\xff\0" * 900] + records[3:],
               "cut.warc": records[:2] + [records[2][:900] + b"\n"] + records[3:], "number.warc": records[:2] + [cut.replace(b"Length: 9", b"Length: x")] + records[3:],
               "head.warc.gz": packed[:2] + [b"\1" + packed[2][1:]] + packed[3:]}
    for name, parts in damaged.items():
        put(tmp_path, name, b"".join(parts))
    put(tmp_path, "whole.warc.gz", b"".join(packed))
    put(tmp_path, "one.warc.gz", gzip.compress(b"".join(records)))
    whole = b"".join(records)
    put(tmp_path, "blocks.warc.gz", b"".join(gzip.compress(whole[k:k + 1000]) for k in range(0, len(whole), 1000)))
    put(tmp_path, "end.warc.gz", b"".join(packed)[:-900])
    got = {}
    for r in sources.read_warc(spark, str(tmp_path)).collect():
        got.setdefault(r.site, []).append(r.url)
    lost = sources.damaged_warc(spark, str(tmp_path)).collect()
    site = {n: i for n, i in spark.createDataFrame([(n,) for n in [*damaged, "whole.warc.gz", "one.warc.gz", "blocks.warc.gz", "end.warc.gz"]], "n string")
            .select("n", scalar.resource_id(F.col("n"))).collect()}
    found = {n: sorted(u[-1] for u in got.get(i, [])) for n, i in site.items()}
    assert found == {n: list("01345") for n in damaged} | {n: list("012345") for n in ("whole.warc.gz", "one.warc.gz", "blocks.warc.gz")} | {"end.warc.gz": list("01234")}
    assert {r.name for r in lost} == {*damaged, "end.warc.gz"} and all(r.reason for r in lost)
    assert all(r.offset >= len(b"".join(damaged[r.name][:2])) for r in lost if r.name in damaged)


def test_archivebox(spark, tmp_path):
    def entry(name, files, when):
        for rel, body in files.items():
            put(tmp_path, f"arch/archive/{name}/{rel}", body, when)

    meta = {"url": "https://example.com/", "canonical": {"dom_path": "output.html", "wget_path": "example.com/index.html"}, "extra": [1]}
    entry("1756357684.13023", {
        "index.json": json.dumps(meta), "headers.json": json.dumps({"Status-Code": 200, "status": "301 Moved", "X-A": "b"}),
        "index.html": "meta page", "output.html": "<h1>dom</h1>", "example.com/index.html": "<h1>wget</h1>",
        "example.com/style.css@v=1": "p{}", "example.com/x.orig": "dup", "media/v.mp4": "m", "cdn.net/a/b.js": "js"}, 1000)
    entry("1756357685.2", {"index.json": json.dumps({"url": "https://example.com/", "canonical": {"dom_path": None, "wget_path": "gone.html"}}),
                           "index.html": "<p>newer"}, 2000)
    entry("1756357686.3", {"index.json": "{broken", "index.html": "<p>unknown"}, 1500)
    entry("1756357687.4", {"other.txt": "no data file"}, 1500)
    put(tmp_path, "arch/archive/notanentry/index.html", "x")
    got = rows_by(sources.read_archivebox(spark, str(tmp_path)), "url")
    assert {u: (r.type, r.status, r.content) for u, r in got.items()} == {
        "https://example.com/": ("html", 200, "<p>newer"), "https://example.com/style.css": ("style", 200, "p{}"),
        "https://cdn.net/a/b.js": ("script", 200, "js"),
        "archivebox://unknown/1756357686.3": ("html", 200, "<p>unknown")}
    assert got["https://example.com/"].headers.startswith("HTTP/1.0 200 OK\r\nContent-Type: text/html")


def test_archivebox_headers_and_preferred_page(spark, tmp_path):
    base = "arch/archive/1.5/"
    put(tmp_path, base + "index.json", json.dumps({"url": "https://e.com/p", "canonical": {"dom_path": "output.html"}}))
    put(tmp_path, base + "headers.json", json.dumps({"Status-Code": 301, "status": "301 Moved", "X-A": "b"}))
    put(tmp_path, base + "output.html", "<h1>dom</h1>")
    row = sources.read_archivebox(spark, str(tmp_path)).first()
    assert (row.status, row.content) == (301, "<h1>dom</h1>")
    assert row.headers == "HTTP/1.0 301\r\nstatus: 301 Moved\r\nX-A: b\r\n\r\n"


def test_site_lists(spark, tmp_path):
    put(tmp_path, "example.com/a.html")
    put(tmp_path, "example.com/robots.txt", "User-agent: *")
    put(tmp_path, "other.org/abc-robots.txt.txt", "https://other.org/robots.txt\n\nGET /\n\nHTTP/1.1 200 OK\n\nDisallow: /x")
    put(tmp_path, "http-client-cache/a")
    put(tmp_path, "box/archive/1.2/index.html")
    (tmp_path / "empty").mkdir()
    put(tmp_path, "c.warc.gz")
    got = rows_by(sources.list_sites(spark, str(tmp_path)), "name")
    assert set(got) == {"example.com", "other.org", "box", "empty"}
    assert (got["example.com"].id, got["example.com"].urls) == (13928348955040, ["https://example.com/"])
    assert (got["example.com"].robots, got["other.org"].robots, got["box"].robots) == ("User-agent: *", "Disallow: /x", None)
    assert [r.name for r in sources.list_sites(spark, str(tmp_path), [13928348955040]).collect()] == ["example.com"]
    assert [(r.name, r.type, r.urls) for r in sources.list_archivebox_sites(spark, str(tmp_path)).collect()] == [
        ("box", "list", ["archivebox://box/"])]
    assert [r.name for r in sources.list_warc_sites(spark, str(tmp_path)).collect()] == ["c.warc.gz"]


def test_project_sites(spark):
    rows = [(1, "a", 1, "https://a.com/\n\n not a url\n", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00.1234567+00:00"),
            (2, "b", 2, None, "", None), (3, "c", 9, "ftp:x", None, None)]
    got = rows_by(sources.sites_from_projects(spark.createDataFrame(
        rows, "id long, name string, type int, urls string, created string, modified string")), "id")
    assert [(got[i].type, got[i].urls) for i in (1, 2, 3)] == [("url", ["https://a.com/"]), ("list", []), ("undefined", ["ftp:x"])]
    assert got[2].created is None and got[1].modified is not None


@pytest.mark.parametrize("buckets", [None, 4])
def test_store_and_prune(spark, pages, tmp_path, buckets):
    path = str(tmp_path / "t")
    counted, seen = sources.observed(pages, f"ingest{buckets}")
    sources.write_resources(counted, path, buckets)
    assert seen.get["processed"] == pages.count()
    site = pages.first().site
    back = sources.load_resources(spark, path, [site], buckets)
    assert back.count() == pages.where(f"site = {site}").count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert ("site_bucket" if buckets else "site") in plan.split("PartitionFilters:")[1].split("]")[0]
    whole = sources.load_resources(spark, path)
    assert whole.exceptAll(sources.table.conform(pages)).count() == 0 and whole.count() == pages.count()


def test_type_codes(spark):
    df = spark.createDataFrame([(0,), (10,), (99,)], "type int")
    assert [r.type for r in sources.table.decode_type_codes(df).collect()] == ["", "style", ""]


def warc_files_of_many_kinds():
    rng = random.Random(7)
    body = lambda n: "".join(rng.choice("abcdefgh \n<>") for _ in range(n)).encode()
    records = [record("response" if k % 4 else "request", f"https://e.com/{k}", http(200, "text/html", body(rng.choice([0, 50, 700, 3000])))) for k in range(40)]
    whole, each = b"".join(records), [gzip.compress(r) for r in records]
    pairs = [gzip.compress(b"".join(records[k:k + 3])) for k in range(0, 40, 3)]
    junk = records[:9] + [b"junk\xff\0" * 90] + records[9:20] + [records[20][:200] + b"\n"] + records[21:]
    packed_junk = each[:9] + [b"no gzip at all" * 20] + each[9:20] + [each[20][:60]] + each[21:30] + [b"\1" + each[30][1:]] + each[31:]
    return {"plain": (whole, False), "members": (b"".join(each), True), "several records a member": (b"".join(pairs), True), "one member": (gzip.compress(whole), True),
            "blocks": (b"".join(gzip.compress(whole[k:k + 1000]) for k in range(0, len(whole), 1000)), True), "damaged": (b"".join(junk), False),
            "damaged members": (b"".join(packed_junk), True), "cut off": (whole[:-500], False), "empty": (b"", False), "empty packed": (b"", True)}


@pytest.mark.parametrize("kind", list(warc_files_of_many_kinds()))
def test_ranges_of_a_warc_file_give_what_the_whole_file_gives(kind):
    data, packed = warc_files_of_many_kinds()[kind]
    whole = list(warc._records(warc._Stream(io.BytesIO(data), packed), warc._textual))
    for size in (37, 500, 1234, 5000, len(data) + 1):
        parts = []
        for start in range(0, max(1, len(data)), size):
            raw, stop = io.BytesIO(data), start + size if start + size < len(data) else float("inf")
            first = warc._first_record(raw, packed, start, stop) if start else 0
            if first is not None:
                raw.seek(0)
                parts.append(list(warc._records(warc._Stream(raw, packed, first), warc._textual, stop)))
        found = [row for part in parts for row in part]
        assert [r for r in found if "url" in r] == [r for r in whole if "url" in r], size
        if kind in ("plain", "members"):
            assert found == whole and len(parts) >= min(8, len(data) // size)
        else:
            assert {r["reason"] for r in found if "reason" in r} == {r["reason"] for r in whole if "reason" in r}


def test_one_warc_file_is_read_by_several_tasks(spark, tmp_path):
    records = [record("response", f"https://e.com/{k}", http(200, "text/html", b"x" * 500)) for k in range(200)]
    put(tmp_path, "a.warc.gz", b"".join(gzip.compress(r) for r in records))
    put(tmp_path, "b.warc", b"".join(records))
    plain = sources.read_warc(spark, str(tmp_path), range_bytes=20_000)
    whole = sources.read_warc(spark, str(tmp_path), range_bytes=None)
    assert plain.count() == whole.count() == 400 and plain.exceptAll(whole).isEmpty()
    tasks = plain.where(F.col("site") == whole.select(F.max("site")).first()[0]).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 1 and plain.select(F.spark_partition_id().alias("p")).distinct().count() >= 5
    assert sources.damaged_warc(spark, str(tmp_path), range_bytes=20_000).count() == 0


def test_files_are_packed_into_tasks_by_bytes(spark, tmp_path):
    for k in range(3000):
        put(tmp_path, f"site/flat/f{k}.html", b"x" * (200_000 if k % 100 == 0 else 10))
    listed = list_files(spark, str(tmp_path))
    assert listed.count() == 3000
    placed = packed(listed, F.col("length"), ["path"], 8 << 20).select("path", "length", F.spark_partition_id().alias("task"))
    loads = placed.groupBy("task").agg(F.sum(F.col("length") + 65536).alias("bytes"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in loads) == 3000 and max(r.bytes for r in loads) <= (8 << 20) + 200_000 + 65536
    assert len(loads) <= -(-sum(r.bytes for r in loads) // (8 << 20)) + 4
    assert packed(listed.limit(0), F.col("length"), ["path"]).count() == 0

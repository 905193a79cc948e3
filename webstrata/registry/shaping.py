"""Normalization rules, result shapes and key-wise reductions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as N
from ..operators import groups
from ..operators import query as q
from ..operators import results as R
from ..plans import files, fixture
from ..sources import table
from .common import has, sql


def _read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pages(run):
    return lambda spark, folder: run(_read(spark, folder, "pages"))


def _resources(run):
    return lambda spark, folder: run(fixture.load_pages(spark, folder))


PATH = r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"
FULL_PATH = f"CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END"
EXT = rf"lower(regexp_extract(p, '[^/](\.[^./]+)$', 1))"

# one MIME type per row, so that every branch of the rules is met
MIME_NAMES = ["text/html; charset=utf-8", "application/javascript", "text/css", "image/png", "application/pdf",
              "text/plain", "audio/mpeg", "video/mp4", "application/json", "application/xml", "font/woff2",
              "application/octet-stream", "application/zip", "x-unknown/thing"]
EXT_NAMES = ["", ".html", ".JS", ".css", ".png", ".svg", ".pdf", ".json", ".docx", ".mov", ".ogg", ".xyz",
             ".min.js202505251919", ".html·123.tmp"]



def _pick(names: list[str]):
    return F.element_at(F.array(*[F.lit(m) for m in names]), (F.col("page_id") % len(names) + 1).cast("int"))


_mime_sql = f"[{', '.join(repr(m) for m in MIME_NAMES)}][(page_id % {len(MIME_NAMES)} + 1)::INT]"
_ext_sql = f"[{', '.join(repr(m) for m in EXT_NAMES)}][(page_id % {len(EXT_NAMES)} + 1)::INT]"


def _mime_types(pages):
    rows = pages.select("page_id", _pick(MIME_NAMES).alias("mime"))
    head = F.concat(F.lit("HTTP/1.1 20"), (F.col("page_id") % 7).cast("string"), F.lit(" X\r\nSERVER: a\r\ncontent-type: "),
                    F.col("mime"), F.lit("\r\n"))
    return rows.select("page_id", "mime", N.type_from_mime(F.col("mime")).alias("type"),
                       N.is_text(F.col("mime")).alias("textual"), N.http_status(head).alias("status"),
                       N.content_type(head).alias("parsed"))


MIME_SQL = f"""
SELECT page_id, mime,
  CASE WHEN contains(mime, 'html') THEN 'html' WHEN contains(mime, 'javascript') THEN 'script'
       WHEN contains(mime, 'css') THEN 'style' WHEN contains(mime, 'image/') THEN 'img'
       WHEN contains(mime, 'pdf') THEN 'pdf' WHEN contains(mime, 'text/') THEN 'text'
       WHEN contains(mime, 'audio/') THEN 'audio' WHEN contains(mime, 'video/') THEN 'video'
       WHEN mime IN ('application/json', 'application/xml') THEN 'text' ELSE 'other' END AS type,
  CASE WHEN starts_with(mime, 'text/') THEN true
       WHEN regexp_matches(mime, '^(font|image|audio|video)/|^application/octet-stream') THEN false
       WHEN starts_with(mime, 'application/') THEN mime IN ('application/json', 'application/xml', 'application/javascript')
       ELSE true END AS textual,
  (200 + page_id % 7)::INT AS status,
  trim(split_part(mime, ';', 1)) AS parsed
FROM (SELECT page_id, {_mime_sql} AS mime FROM pages)"""


def _ext_types(pages):
    path = F.concat(F.lit("/Site/file"), F.col("page_id").cast("string"), _pick(EXT_NAMES))
    rows = pages.select("page_id", path.alias("path"))
    clean = N.decruft_path(F.col("path"))
    return rows.select("page_id", clean.alias("clean"), N.extension(clean).alias("extension"),
                       N.type_from_extension(N.extension(clean)).alias("type"))


EXT_SQL = rf"""
SELECT page_id, clean, lower(regexp_extract(clean, '[^/](\.[^./]+)$', 1)) AS extension,
  CASE lower(regexp_extract(clean, '[^/](\.[^./]+)$', 1))
    WHEN '' THEN 'html' WHEN '.html' THEN 'html' WHEN '.js' THEN 'script' WHEN '.css' THEN 'style' WHEN '.png' THEN 'img'
    WHEN '.svg' THEN 'img' WHEN '.pdf' THEN 'pdf' WHEN '.json' THEN 'text' WHEN '.docx' THEN 'doc' WHEN '.mov' THEN 'video'
    WHEN '.ogg' THEN 'audio' ELSE 'other' END AS type
FROM (SELECT page_id, regexp_replace(regexp_replace(lower('/Site/file' || page_id || {_ext_sql}),
        '·?[0-9]+\.tmp|[0-9]{{12}}|\.tmp', '', 'g'), '\.([\p{{L}}\p{{N}}_]+)[^\p{{L}}\p{{N}}_]*$', '.\1') AS clean FROM pages)"""


def _normalize(pages):
    url = F.col("url")
    # a site-relative file name stands in for the page's path
    rel = F.concat(F.lit("a\\b/"), F.regexp_replace("url", r"^[a-z]+://[^/]*/?", ""), F.lit("/index.html"))
    asset = F.concat("url", F.lit("@v=1.2"))
    return pages.select(
        "page_id", N.host(url).alias("host"), N.scheme(url).alias("scheme"), N.url_path(url).alias("path"),
        N.path_segment(url, 1).alias("first"), N.path_segment(url, 2).alias("second"),
        N.display_url(url).alias("display"), N.path_to_url(N.host(url), rel).alias("file_url"),
        N.collapse_index(N.path_to_url(N.host(url), rel)).alias("collapsed"),
        N.collapse_index_end(F.concat(N.host(url), F.lit("/x/index.htm"))).alias("collapsed_end"),
        N.clean_asset_url(asset).alias("asset"),
        N.strip_wildcards(F.concat(F.lit("*\""), "url", F.lit("`*"))).alias("stripped"))


_REL = r"'a/b/' || regexp_replace(url, '^[a-z]+://[^/]*/?', '') || '/index.html'"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
NORMALIZE_SQL = rf"""
SELECT page_id, {_HOST} AS host, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {FULL_PATH} AS path,
  nullif(split_part({FULL_PATH}, '/', 2), '') AS first, nullif(split_part({FULL_PATH}, '/', 3), '') AS second,
  regexp_replace(url, '^https?://|/$', '', 'g') AS display, 'https://' || {_HOST} || '/' || {_REL} AS file_url,
  regexp_replace('https://' || {_HOST} || '/' || {_REL}, '/index\.html($|\?)', '/\1', 'g') AS collapsed,
  {_HOST} || '/x/' AS collapsed_end, split_part(url || '@v=1.2', '@', 1) AS asset, url AS stripped
FROM pages"""


def _formats(resources):
    fine = F.timestamp_micros(F.unix_micros("created") + F.col("time") * 1001)
    return resources.select(
        "id", N.iso_zulu(fine).alias("iso"), N.parse_zulu(N.iso_zulu(fine)).isNotNull().alias("parsed"),
        (N.parse_zulu(F.concat(F.lit("2024-01-01T00:00:00.1234567"), F.lit("Z"))) ==
         F.lit("2024-01-01 00:00:00.123456").cast("timestamp")).alias("cut"),
        N.duration_hms(F.col("size") + F.col("time").cast("double") / 512).alias("duration"),
        N.human_bytes(F.col("size")).alias("bytes"), N.human_bytes(F.col("size") * 1000).alias("kilobytes"),
        N.encode_type(F.col("type")).alias("code"))


_FINE = "(created + to_microseconds(time::BIGINT * 1001))"
FORMATS_SQL = sql(rf"""
SELECT id, strftime({_FINE}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN time = 0 THEN '' ELSE '.' || lpad((time * 1001)::VARCHAR, 6, '0') END || 'Z' AS iso,
  true AS parsed, true AS cut,
  printf('%02d:%02d:%02d.%03d', size // 3600, (size % 3600) // 60, size % 60, time * 1000 // 512) AS duration,
  CASE WHEN size >= 1048576 THEN printf('%.1fMB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1fKB', size / 1024.0)
       ELSE size || 'B' END AS bytes,
  CASE WHEN size * 1000 >= 1048576 THEN printf('%.1fMB', size * 1000 / 1048576.0) WHEN size * 1000 >= 1024
       THEN printf('%.1fKB', size * 1000 / 1024.0) ELSE size * 1000 || 'B' END AS kilobytes,
  CASE type WHEN 'img' THEN 3 WHEN 'script' THEN 8 WHEN 'style' THEN 7 ELSE 1 END::INT AS code
FROM r""")

CODES_SQL = """
SELECT page_id, CASE page_id % 17 WHEN 0 THEN '' WHEN 1 THEN 'html' WHEN 3 THEN 'rss' WHEN 4 THEN 'iframe' WHEN 6 THEN 'img'
  WHEN 7 THEN 'audio' WHEN 8 THEN 'video' WHEN 9 THEN 'font' WHEN 10 THEN 'style' WHEN 11 THEN 'script' WHEN 13 THEN 'text'
  WHEN 14 THEN 'pdf' WHEN 15 THEN 'doc' WHEN 16 THEN NULL ELSE 'other' END AS type FROM pages"""


def _type_codes(pages):
    return pages.select("page_id", N.decode_type(F.col("page_id") % 17).alias("type"))


def _result_json(resources):
    slim = q.search(resources, q.field("type", "html")).select(
        "id", "site", "url", F.when(F.col("time") % 2 == 0, F.col("size")).alias("size"),
        F.when(F.col("time") % 3 == 0, F.col("created")).alias("created"))
    return R.to_json(slim, ["size"])


JSON_SQL = sql("""
SELECT id, CASE WHEN time % 2 = 1 THEN '{"size":null,' ELSE '{' END || '"id":' || id || ',"site":' || site || ',"url":"' || url || '"'
  || CASE WHEN time % 2 = 0 THEN ',"size":' || size ELSE '' END
  || CASE WHEN time % 3 = 0 THEN ',"created":"' || strftime(created, '%Y-%m-%dT%H:%M:%S') || 'Z"' ELSE '' END || '}' AS json
FROM r WHERE type = 'html' AND status >= 100""")


def _latest(spark, folder):
    events = _read(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return (groups.latest_by(events, ["user_id"], [F.col("ts"), -F.col("event_id")])
            .select("user_id", "event_id", "event_type", "value"))


def _site_join(resources):
    sites = resources.groupBy(F.col("site").alias("id")).agg(F.min(N.host(F.col("url"))).alias("name"))
    joined = R.with_sites(resources.select("site", "size"), sites)
    return joined.groupBy("site_name").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def _merged(spark, folder):
    """The pages stored, then merged with later captures of those that were not found and earlier ones of all others."""
    pages = fixture.load_pages(spark, folder)
    path = f"{groups.work_folder(spark)}/webstrata/captures-{uuid.uuid4().hex}"
    later = pages.where("status = 404").withColumn("status", F.lit(410)).withColumn("content", F.lit(None).cast("string")).withColumn("modified", F.col("modified") + F.expr("INTERVAL 1 DAY"))
    earlier = pages.where("status <> 404").withColumn("content", F.lit("old")).withColumn("modified", F.col("modified") - F.expr("INTERVAL 1 DAY"))
    table.merge_resources(spark, path, pages, 8)
    table.merge_resources(spark, path, later.unionByName(earlier), 8)
    return table.load_resources(spark, path).select("id", "site", "url", "status", "content")


def _result_sets(resources):
    # each result is used four times: search once
    one = groups.cut(q.search(resources, q.field("content", "the")).select("id"))
    two = groups.cut(q.search(resources, q.field("content", "of")).select("id"))
    parts = {"union": one.union(two).distinct(), "intersect": one.intersect(two), "except": one.exceptAll(two),
             "without": one.join(two, "id", "left_anti")}
    frames = [df.select(F.lit(n).alias("operation"), "id") for n, df in parts.items()]
    result = frames[0]
    for f in frames[1:]:
        result = result.unionByName(f)
    return result


_A, _B = has("the", ("content",)), has("of", ("content",))
SETS_SQL = sql(" UNION ALL ".join(f"SELECT '{n}' AS operation, id FROM r WHERE status >= 100 AND {c}" for n, c in {
    "union": f"({_A} OR {_B})", "intersect": f"{_A} AND {_B}", "except": f"{_A} AND NOT {_B}", "without": f"{_A} AND NOT {_B}"}.items()))

QUERIES = {
    "result_sets": (_resources(_result_sets), SETS_SQL),
    "stratified_sample": (_resources(lambda r: R.stratified_sample(r, 7, 42).select("id", "site", "type")),
                          sql("SELECT id, site, type FROM r QUALIFY row_number() OVER (PARTITION BY type ORDER BY sha1('42:' || site || ':' || id), site, id) <= 7")),
    "merged_captures": (_merged, sql("SELECT id, site, url, CASE WHEN status = 404 THEN 410 ELSE status END::INT AS status, "
                                     "CASE WHEN status = 404 THEN NULL ELSE content END AS content FROM r")),
    "site_join": (_resources(_site_join), sql(f"SELECT {_HOST} AS site_name, count(*) AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY 1")),
    "result_facets": (_resources(lambda r: R.facets(r, q.text("the"))),
                      sql(" UNION ALL ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS value, count(*) AS n FROM r WHERE {has('the')} "
                                             "AND status >= 100 GROUP BY 2" for f in ("site", "type", "status")))),
    "resource_ids": (_pages(lambda p: p.select("page_id", N.resource_id(F.col("url")).alias("id"), N.resource_id(N.host(F.col("url"))).alias("site"))),
                     "SELECT page_id, ('0x' || substr(sha1(url), 1, 12))::BIGINT AS id, "
                     f"('0x' || substr(sha1({_HOST}), 1, 12))::BIGINT AS site FROM pages"),
    "normalize_urls": (_pages(_normalize), NORMALIZE_SQL),
    "mime_types": (_pages(_mime_types), MIME_SQL),
    "ext_types": (_pages(_ext_types), EXT_SQL),
    "headers_synth": (_resources(lambda r: r.select("id", "headers", N.http_status(F.col("headers")).alias("status"),
                                                    N.content_type(F.col("headers")).alias("mime"))),
                      sql("SELECT id, headers, 200::INT AS status, regexp_extract(headers, 'Content-Type: ([a-z/]+)', 1) AS mime FROM r")),
    "format_scalars": (_resources(_formats), FORMATS_SQL),
    "type_codes": (_pages(_type_codes), CODES_SQL),
    "image_urls": (_resources(files.image_urls),
                   sql("SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM r WHERE type = 'img'")),
    "page_results": (_resources(lambda r: R.search_page(r, q.text("the"), ["size", "created"], "+url", 10, 20)
                                .withColumn("created", N.iso_zulu(F.col("created")))),
                     sql("SELECT id, url, site, type, status, strftime(created, '%Y-%m-%dT%H:%M:%SZ') AS created, size FROM r "
                         f"WHERE {has('the')} AND status >= 100 ORDER BY url, id LIMIT 10 OFFSET 20")),
    "sort_size_desc": (_resources(lambda r: R.search_page(r, q.match_all(), ["size"], "-size", 25)),
                       sql("SELECT id, url, site, type, status, size FROM r WHERE status >= 100 ORDER BY size DESC, id, site LIMIT 25")),
    "page_navigation": (_resources(lambda r: R.navigation(r, q.text("the"), 20, 20)),
                        sql("SELECT count(*) AS total, 2::BIGINT AS page, ceil(count(*) / 20.0)::BIGINT AS pages, true AS has_previous, "
                            f"40 < count(*) AS has_next FROM r WHERE {has('the')} AND status >= 100")),
    "result_json": (_resources(_result_json), JSON_SQL),
    "dedupe_latest": (_latest, "SELECT user_id, event_id, event_type, value FROM events "
                               "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1"),
    "duplicate_texts": (lambda spark, folder: groups.duplicates(
        _read(spark, folder, "documents").select(F.sha2("text", 256).alias("hash")), ["hash"]),
        "SELECT sha256(text) AS hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1"),
}

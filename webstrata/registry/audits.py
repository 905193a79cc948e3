"""Audit jobs over the page archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups
from ..operators import query as q
from ..plans import errors, facts, files, fixture, perf, seo
from .common import BOTH, HTML, has, sql
from .shaping import FULL_PATH

DOMAIN = "example.com"
SEEN = "status >= 100"


def _resources(run):
    return lambda spark, folder: run(fixture.load_pages(spark, folder))


def _html(run):
    return lambda spark, folder: run(fixture.load_html(spark, folder))


def _facts(run):
    return lambda spark, folder: run(facts.page_facts(fixture.load_html(spark, folder)))


def _links(run):
    def query(spark, folder):
        resources = fixture.load_html(spark, folder)
        return run(facts.link_table(resources), resources)
    return query


def _referrers(links, resources):
    links = groups.cut(links)  # read twice
    return perf.broken_link_referrers(links, perf.broken_links(links, resources))


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
RELATION = (f"CASE WHEN {HOST} IN ('{DOMAIN}', 'www.{DOMAIN}') THEN 'main' "
            f"WHEN ends_with({HOST}, '.{DOMAIN}') THEN 'subdomain' ELSE 'external' END")
TEMPLATE = f"regexp_replace({FULL_PATH}, '[0-9]+', '{{n}}', 'g')"


def _squash(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def _plain(text: str) -> str:
    for name, char in facts.ENTITIES:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


TITLE = f"nullif({_plain(_squash(chr(39).join(['regexp_extract(content, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)'])))}, '')"
VISIBLE = _squash("regexp_replace(content, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')")
WORDS = rf"list_filter(string_split_regex(lower({VISIBLE}), '[^\p{{L}}\p{{N}}_-]+'), lambda x: x <> '')"
LEVELS = r"regexp_extract_all(content, '(?i)<h([1-6])[\s>]', 1)"
H1 = _plain(_squash("regexp_replace(x, '<[^>]*>', ' ', 'g')"))
H1_LENGTH = f"list_max(list_transform(regexp_extract_all(content, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda x: length({H1})))"
BREAKS = f"len(list_filter(list_zip({LEVELS}[:-2], {LEVELS}[2:]), lambda x: x[2]::INT > x[1]::INT + 1))"

PAGE_FACTS = rf"""p AS (
  SELECT site, id, url, {TITLE} AS title,
    nullif(regexp_extract(content, '(?is)<meta\s[^>]*name="description"[^>]*content="([^"]*)"', 1), '') AS description,
    contains(content, 'rel="canonical"') AS has_canonical, contains(content, 'og:title') AS has_og_title,
    contains(content, 'og:description') AS has_og_description, contains(content, 'og:image') AS has_og_image,
    contains(content, 'name="viewport"') AS has_viewport, regexp_matches(content, '(?i)<html[^>]*\slang=') AS has_lang,
    contains(content, 'application/ld+json') AS has_json_ld,
    {WORDS} AS words, sha256(lower({VISIBLE})) AS text_hash, {LEVELS} AS levels, {BREAKS}::BIGINT AS breaks,
    coalesce({H1_LENGTH}, 0) AS h1_length,
    len(regexp_extract_all(content, '(?i)<img[\s>]')) AS images,
    len(regexp_extract_all(content, '(?i)<img[^>]*\salt=')) AS images_with_alt
  FROM r WHERE type = 'html' AND content IS NOT NULL)"""
H1_COUNT = "len(list_filter(levels, lambda x: x = '1'))"


def _verdict(name: str, low: int, high: int) -> str:
    return (f"CASE WHEN {name} IS NULL THEN 'missing' WHEN length({name}) < {low} THEN 'short' "
            f"WHEN length({name}) > {high} THEN 'long' ELSE 'optimal' END")


def _alone(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY {name}) END"


def _facts_sql(select: str) -> str:
    return sql(select, HTML, PAGE_FACTS)


SCORE = f"""s AS (SELECT site, id, url, {H1_COUNT} <> 1 AS h1_not_single, {_alone('title')} > 1 AS title_duplicate,
    description IS NULL AS description_missing, {_verdict('title', 30, 60)} <> 'optimal' AS title_length,
    breaks > 0 AS hierarchy_broken, coalesce(lower(title) IN ('page title', 'untitled'), false) AS title_generic,
    h1_length > 70 AS h1_too_long, images > images_with_alt AS alt_missing, NOT list_contains(levels, '2') AS no_h2
  FROM p)"""
ISSUES = ["h1_not_single", "title_duplicate", "description_missing", "title_length", "hierarchy_broken",
          "title_generic", "h1_too_long", "alt_missing", "no_h2"]


def _sum(names: list[str]) -> str:
    return " + ".join(f"{n}::BIGINT" for n in names)


# every reference of the given pages is an <a href="/..."> outside scripts
ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
HREF = ("CASE WHEN starts_with(href_raw, '/') THEN " + ORIGIN + " || regexp_replace(href_raw, '#.*$', '') ELSE "
        "regexp_replace(href_raw, '#.*$', '') END")
LINKS = rf"""l AS (
  SELECT site, id, url, pos, 'a' AS tag, '' AS rel, href_raw, {HREF} AS href, {HOST} AS host, true AS internal
  FROM (SELECT site, id, url, {_plain('trim(unnest(h))')} AS href_raw, (generate_subscripts(h, 1) - 1)::INT AS pos
        FROM (SELECT site, id, url, regexp_extract_all(content, '<a href="([^"]*)"', 1) AS h
              FROM r WHERE type = 'html' AND content IS NOT NULL)))"""
CAPTURED = f"c AS (SELECT regexp_replace(url, '#.*$', '') AS href, min(status) AS status FROM r WHERE {SEEN} GROUP BY 1)"
TARGETS = ("g AS (SELECT href, count(DISTINCT url) AS pages, count(*) AS refs, min(url) AS example FROM l GROUP BY href)")
BROKEN = ("b AS (SELECT g.href, c.status, g.pages, g.refs, g.example FROM g LEFT JOIN c ON g.href = c.href "
          "WHERE c.status IS NULL OR c.status >= 400)")


def _links_sql(select: str) -> str:
    return sql(select, HTML, ", ".join([LINKS, CAPTURED, TARGETS, BROKEN]))


STATUS_SQL = sql(f"""
SELECT *, round(100.0 * not_found / nullif(pages, 0), 6)::DOUBLE AS rate,
  CASE WHEN pages = 0 THEN NULL WHEN 100.0 * not_found / pages < 0.5 THEN 'A' WHEN 100.0 * not_found / pages < 1 THEN 'B'
       WHEN 100.0 * not_found / pages < 2 THEN 'C' WHEN 100.0 * not_found / pages <= 3 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT site, count_if(type = 'html')::BIGINT AS pages, count_if(status BETWEEN 400 AND 499)::BIGINT AS client_errors,
        count_if(status >= 500)::BIGINT AS server_errors, count_if(status = 404)::BIGINT AS not_found
      FROM r WHERE {SEEN} GROUP BY ROLLUP (site))""")

PATTERN = (r"CASE WHEN regexp_matches(lower(url), '[?&;](search_)?page=|/p/|[?&;]offset=') THEN 'pagination' "
           r"WHEN regexp_matches(lower(url), '/(api|wp-json|rest|oembed)/') THEN 'api' "
           r"WHEN regexp_matches(lower(url), '\.(m4r|pdf|jpe?g|png|gif|webp|svg|bmp|tiff?|mp3|mp4|mov|ogg|webm)([?#]|$)|/(multimedia|images|downloads)/') THEN 'media' "
           "WHEN starts_with(url, 'http://') THEN 'insecure' ELSE 'other' END")

ASSET_CLASS = (f"CASE WHEN {HOST} IN ('{DOMAIN}', 'www.{DOMAIN}') THEN 'main' "
               f"WHEN ends_with({HOST}, '.{DOMAIN}') AND regexp_matches({HOST}, "
               r"'^(static|cdn|assets?|media|img|images|js|css|files|downloads)[0-9]*\.') THEN 'asset subdomain' "
               f"WHEN ends_with({HOST}, '.{DOMAIN}') THEN 'subdomain' ELSE 'external' END")
ASSET_HOSTS = ("a AS (SELECT *, CASE WHEN class = 'main' THEN 1 WHEN regexp_matches(host, 'static|cdn|assets|media') THEN 3 "
               "WHEN class = 'external' THEN 0 ELSE 2 END AS score FROM (SELECT " + HOST + " AS host, any_value(" + ASSET_CLASS
               + ") AS class, count(*) AS n, sum(size)::BIGINT AS bytes FROM r WHERE type IN ('img', 'script', 'style') GROUP BY 1))")

SECTIONS = ("SELECT 'all' AS section, url FROM r WHERE status >= 100 UNION ALL "
            "SELECT type, url FROM r WHERE status >= 100 UNION ALL "
            f"SELECT 'keyword', url FROM r WHERE status >= 100 AND type = 'html' AND {has('and')}")

# the given pages load nothing: these variants get style sheets, scripts and pictures that depend on their size
ASSETS = ["<link rel=\"stylesheet\" href=\"/all.css\">", "<link rel=\"stylesheet\" href=\"https://cdn.example.org/a.css\">",
          "<script src=\"/one.js\"></script>", "<script async src=\"/two.js\"></script>", "<img src=\"/p.png\" alt=\"p\">"]


def with_assets(resources):
    """Pages with the asset tags whose number divides their size put at their end."""
    added = F.concat(*[F.when(F.col("size") % (k + 1) == 0, t).otherwise("") for k, t in enumerate(ASSETS)])
    return resources.withColumn("content", F.concat("content", F.lit("<hr>"), added))


_CHECKS = [f"(size % {k + 1} = 0)::BIGINT" for k in range(len(ASSETS))]
# an unclosed script or style of the page itself would swallow what is added: the given pages have none
BLOCKERS = rf"""k AS (SELECT site, id, url, {_CHECKS[0]} + {_CHECKS[1]} AS stylesheets, {_CHECKS[2]} + {_CHECKS[3]} AS scripts, {_CHECKS[2]} AS blocking_scripts,
    len(regexp_extract_all(content, '(?is)<style[^>]*>'))::BIGINT AS inline_styles,
    list_sum(list_transform(regexp_extract_all(content, '(?is)<style[^>]*>(.*?)</style>', 1), lambda x: strlen(x)))::BIGINT AS inline_css_bytes,
    len(regexp_extract_all(content, '(?is)<script[^>]*>'))::BIGINT AS inline_scripts,
    list_sum(list_transform(regexp_extract_all(content, '(?is)<script[^>]*>(.*?)</script>', 1), lambda x: strlen(x)))::BIGINT AS inline_js_bytes,
    {_CHECKS[0]} + {_CHECKS[1]} + {_CHECKS[2]} AS blockers
  FROM r)"""
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
SHARED_SQL = sql(f"""SELECT href, count(*) AS pages, CASE WHEN count(*) > 1 THEN 'global' WHEN count_if(home) > 0 THEN 'homepage' ELSE 'single page' END AS scope
FROM (SELECT DISTINCT site, id, {FULL_PATH} = '/' AS home, unnest(list_filter([
  CASE WHEN size % 1 = 0 THEN {_ORIGIN} || '/all.css' END, CASE WHEN size % 2 = 0 THEN 'https://cdn.example.org/a.css' END,
  CASE WHEN size % 3 = 0 THEN {_ORIGIN} || '/one.js' END, CASE WHEN size % 4 = 0 THEN {_ORIGIN} || '/two.js' END,
  CASE WHEN size % 5 = 0 THEN {_ORIGIN} || '/p.png' END], lambda x: x IS NOT NULL)) AS href FROM r) GROUP BY href""", HTML)

# the given pages hold inline styles and scripts; their own function call serves as an extra pattern
PATTERNS = {**perf.ANTI_PATTERNS, "tracking call": r"\btrack\([0-9]+\)", "inline margin": r"margin:0"}
ANTI_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS pattern, type, sum(len(regexp_extract_all(content, '{p}')))::BIGINT AS occurrences, "
    f"count_if(regexp_matches(content, '{p}'))::BIGINT AS files FROM r WHERE type IN ('html', 'style', 'script') GROUP BY type"
    for n, p in {k: v.replace(chr(92) + "b", "") if k != "tracking call" else v for k, v in PATTERNS.items()}.items())

SMALL_LIMITS, SMALL_LARGE = {"img": 4000, "script": 3000, "style": 2500}, {"script": 1500, "style": 1500}
TIER = ("CASE WHEN size > CASE type WHEN 'img' THEN 4000 WHEN 'script' THEN 3000 ELSE 2500 END THEN 'oversized' "
        "WHEN type <> 'img' AND size > 1500 THEN 'large' ELSE 'ok' END")

QUERIES = {
    "status_summary": (_resources(errors.status_summary), STATUS_SQL),
    "errors_on_off_site": (_resources(lambda r: errors.errors_on_off_site(r, DOMAIN)),
                           sql(f"SELECT contains(url, '{DOMAIN}') AS on_site, count(*) AS n, count(DISTINCT site) AS sites "
                               "FROM r WHERE status = 404 GROUP BY 1")),
    "error_patterns": (_resources(errors.error_patterns),
                       sql(f"SELECT pattern, n, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS share, "
                           f"100.0 * n / sum(n) OVER () >= 50 AS dominant FROM (SELECT {PATTERN} AS pattern, count(*) AS n "
                           "FROM r WHERE status = 404 GROUP BY 1)")),
    "domain_breakdown": (_resources(lambda r: errors.domain_breakdown(r, DOMAIN)),
                         sql(f"SELECT {HOST} AS host, count(*) AS n, count_if(status = 404)::BIGINT AS not_found, "
                             f"count_if(starts_with(url, 'http://'))::BIGINT AS insecure, any_value({RELATION}) AS relation "
                             "FROM r GROUP BY 1")),
    "type_counts": (_resources(files.type_counts),
                    sql("SELECT site, type, count(*) AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY ROLLUP (site, type)")),
    "size_stats": (_resources(files.size_stats),
                   sql("SELECT type, count(*) AS n, max(size) AS largest, round(avg(size), 4) AS average, "
                       "quantile_disc(size, 0.5) AS median, quantile_disc(size, 0.9) AS p90 FROM r GROUP BY type")),
    "crawl_report": (_resources(lambda r: files.crawl_report(r, q.text("and").column())),
                     sql(f"SELECT section, count(*) AS total FROM ({SECTIONS}) GROUP BY 1")),
    "crawl_report_urls": (_resources(lambda r: files.crawl_report_urls(r, q.text("and").column())), sql(SECTIONS)),
    "file_types": (_resources(lambda r: files.file_types(r, DOMAIN)),
                   sql(f"SELECT type, count_if(contains(url, '{DOMAIN}'))::BIGINT AS internal, "
                       f"count_if(NOT contains(url, '{DOMAIN}'))::BIGINT AS external, count(*) AS total, sum(size)::BIGINT AS bytes "
                       "FROM r GROUP BY type")),
    "site_file_types": (_resources(lambda r: files.file_types(r, DOMAIN, ("site",))),
                        sql(f"SELECT site, type, count_if(contains(url, '{DOMAIN}'))::BIGINT AS internal, "
                            f"count_if(NOT contains(url, '{DOMAIN}'))::BIGINT AS external, count(*) AS total, sum(size)::BIGINT AS bytes "
                            "FROM r GROUP BY ALL")),
    "site_directories": (_resources(lambda r: files.directories(r, 1, ("site",))),
                         sql(f"SELECT site, split_part({FULL_PATH}, '/', 2) AS directory, count(*) AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY ALL")),
    "site_url_templates": (_resources(lambda r: files.url_templates(r, ("site",))),
                           sql(f"SELECT site, {TEMPLATE} AS template, count(*) AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY ALL")),
    "asset_hosts": (_resources(lambda r: files.asset_hosts(r, DOMAIN)),
                    sql("SELECT host, class, n, bytes, score FROM a", more=ASSET_HOSTS)),
    "best_asset_host": (_resources(lambda r: files.best_asset_host(r, DOMAIN)),
                        sql("SELECT host, score FROM a ORDER BY score DESC, n DESC, host DESC LIMIT 1", more=ASSET_HOSTS)),
    "directories": (_resources(lambda r: files.directories(r, 1)),
                    sql(f"SELECT split_part({FULL_PATH}, '/', 2) AS directory, count(*) AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY 1")),
    "url_templates": (_resources(files.url_templates),
                      sql(f"SELECT {TEMPLATE} AS template, count(*) AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY 1")),
    "template_sample": (_resources(lambda r: files.template_sample(r, 3)),
                        sql("SELECT * FROM (SELECT template, count(*) OVER (PARTITION BY template) AS pages, "
                            "row_number() OVER (PARTITION BY template ORDER BY url, id, site) AS rank, site, id, url "
                            f"FROM (SELECT site, id, url, {TEMPLATE} AS template FROM r WHERE type = 'html')) WHERE rank <= 3")),
    "format_mix": (_resources(files.format_mix),
                   sql(rf"SELECT lower(regexp_extract({FULL_PATH}, '[^/](\.[^./]+)$', 1)) AS extension, count(*) AS n, "
                       "sum(size)::BIGINT AS bytes, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share "
                       "FROM r WHERE type = 'img' GROUP BY 1")),
    "oversized": (_resources(lambda r: files.oversized(r, SMALL_LIMITS, SMALL_LARGE)),
                  sql(f"SELECT site, id, url, type, size, {TIER} AS tier FROM r WHERE type <> 'html' AND {TIER} <> 'ok'")),
    "size_tiers": (_resources(lambda r: files.size_tiers(r, SMALL_LIMITS, SMALL_LARGE)),
                   sql(f"SELECT type, {TIER} AS tier, count(*) AS n, sum(size)::BIGINT AS bytes FROM r WHERE type <> 'html' GROUP BY 1, 2")),
    "freshness": (_resources(files.freshness),
                  sql("SELECT count(*) AS pages, max(modified)::DATE::VARCHAR AS newest, count_if(fresh)::BIGINT AS fresh, "
                      "round(100.0 * count_if(fresh) / count(*), 6)::DOUBLE AS share FROM (SELECT modified, modified::DATE >= "
                      "(SELECT max(modified)::DATE - INTERVAL 6 MONTH FROM r WHERE type = 'html') AS fresh FROM r WHERE type = 'html')")),
    "links": (_links(lambda l, r: l),
              _links_sql("SELECT site, id, url, pos, tag, rel, href_raw, href, host, internal FROM l")),
    "broken_links": (_links(perf.broken_links), _links_sql("SELECT href, status, pages, refs, example FROM b")),
    "broken_link_referrers": (_links(_referrers),
                              _links_sql("SELECT DISTINCT l.href, l.url FROM l JOIN b ON l.href = b.href")),
    "shared_assets": (lambda spark, folder: perf.shared_assets(facts.link_table(with_assets(fixture.load_html(spark, folder)))), SHARED_SQL),
    "shared_links": (_links(lambda l, r: perf.shared_links(l)),
                      _links_sql("SELECT href, count(DISTINCT url) AS pages FROM l GROUP BY href")),
    "link_counts": (_links(lambda l, r: perf.link_counts(l)),
                    _links_sql("SELECT site, id, url, count(*) AS internal_links, 0::BIGINT AS external_links FROM l GROUP BY 1, 2, 3")),
    "orphan_assets": (lambda spark, folder: files.orphan_assets(fixture.load_pages(spark, folder), facts.link_table(fixture.load_html(spark, folder))),
                      sql(f"SELECT site, id, url, type, size FROM r WHERE type <> 'html' AND {SEEN} "
                          "AND regexp_replace(url, '#.*$', '') NOT IN (SELECT href FROM l)", BOTH, LINKS.replace("FROM r", "FROM h"))),
    "title_audit": (_facts(seo.title_audit),
                    _facts_sql(f"SELECT site, id, url, title, length(title)::INT AS length, {_verdict('title', 30, 60)} AS verdict, "
                               f"{_alone('title')} AS pages_with_title FROM p")),
    "title_summary": (_facts(seo.title_summary),
                      _facts_sql(f"SELECT verdict, count(*) AS pages, count_if(n > 1)::BIGINT AS duplicated FROM (SELECT "
                                 f"{_verdict('title', 30, 60)} AS verdict, {_alone('title')} AS n FROM p) GROUP BY 1")),
    "meta_audit": (_facts(seo.meta_audit),
                   _facts_sql(f"SELECT site, id, url, length(description)::INT AS length, {_verdict('description', 120, 158)} AS verdict, "
                              f"{_alone('description')} AS pages_with_description, has_canonical, has_og_title, has_og_description, "
                              "has_og_image, has_viewport, has_lang, has_json_ld FROM p")),
    "heading_audit": (_facts(seo.heading_audit),
                      _facts_sql(f"SELECT site, id, url, len(levels)::BIGINT AS headings, {H1_COUNT}::BIGINT AS h1_count, CASE {H1_COUNT} "
                                 "WHEN 0 THEN 'missing' WHEN 1 THEN 'single' ELSE 'multiple' END AS h1_verdict, breaks, "
                                 "h1_length > 70 AS h1_too_long FROM p")),
    "content_quality": (_facts(seo.content_quality),
                        _facts_sql("SELECT site, id, url, len(words)::BIGINT AS words, images::BIGINT AS images, "
                                   "(images - images_with_alt)::BIGINT AS images_without_alt, "
                                   "count(*) OVER (PARTITION BY text_hash) AS pages_with_text FROM p")),
    "keyword_density": (_html(lambda r: seo.keyword_density(r, "the")),
                        _facts_sql("SELECT *, CASE WHEN density < 1 THEN 'low' WHEN density <= 3 THEN 'right' WHEN density > 3 "
                                   "THEN 'stuffed' END AS band FROM (SELECT site, id, url, len(list_filter(words, lambda w: w = 'the'))::BIGINT AS hits, "
                                   "len(words)::BIGINT AS words, round(100.0 * len(list_filter(words, lambda w: w = 'the')) / "
                                   "nullif(len(words), 0), 6)::DOUBLE AS density FROM p)")),
    "page_scorecard": (_facts(seo.page_scorecard),
                       sql(f"SELECT *, {_sum(ISSUES[:5])} AS high, {_sum(ISSUES[5:8])} AS medium, {_sum(ISSUES[8:])} AS low FROM s",
                           table=HTML, more=PAGE_FACTS + ", " + SCORE)),
    "issue_matrix": (_facts(lambda f: seo.issue_matrix(seo.page_scorecard(f))),
                     sql(f"SELECT {TEMPLATE} AS template, count(*) AS pages, "
                         + ", ".join(f"count_if({n})::BIGINT AS {n}" for n in ISSUES) + " FROM s GROUP BY 1",
                         table=HTML, more=PAGE_FACTS + ", " + SCORE)),
    "render_blockers": (_html(lambda r: perf.render_blockers(with_assets(r))), sql("SELECT * FROM k", more=BLOCKERS, table=HTML)),
    "performance_totals": (lambda spark, folder: perf.performance_totals(
        fixture.load_pages(spark, folder), perf.render_blockers(with_assets(fixture.load_html(spark, folder)))),
                           sql("SELECT 'css_bytes' AS metric, sum(size)::BIGINT AS value, 204800::BIGINT AS benchmark, sum(size) < 204800 AS ok "
                               "FROM r WHERE type = 'style' UNION ALL SELECT 'js_bytes', sum(size)::BIGINT, 512000, sum(size) < 512000 FROM r "
                               f"WHERE type = 'script' UNION ALL SELECT 'asset_hosts', count(DISTINCT {HOST}), 3, count(DISTINCT {HOST}) <= 3 "
                               "FROM r WHERE type IN ('style', 'script') UNION ALL SELECT 'blockers', max(blockers), 3, max(blockers) < 3 FROM k",
                               BOTH, BLOCKERS.replace("FROM r", "FROM h"))),
    "site_performance": (lambda spark, folder: perf.performance_totals(
        fixture.load_pages(spark, folder), perf.render_blockers(with_assets(fixture.load_html(spark, folder))), ("site",)),
                         sql("SELECT site, unnest(['css_bytes', 'js_bytes', 'asset_hosts']) AS metric, unnest([css, js, hosts])::BIGINT AS value, "
                             "unnest([204800, 512000, 3])::BIGINT AS benchmark, unnest([css < 204800, js < 512000, hosts <= 3]) AS ok FROM ("
                             "SELECT site, coalesce(sum(size) FILTER (type = 'style'), 0) AS css, coalesce(sum(size) FILTER (type = 'script'), 0) AS js, "
                             f"count(DISTINCT {HOST}) AS hosts FROM r WHERE type IN ('style', 'script') GROUP BY site) "
                             "UNION ALL SELECT site, 'blockers', max(blockers), 3, max(blockers) < 3 FROM k GROUP BY site",
                             BOTH, BLOCKERS.replace("FROM r", "FROM h"))),
    "anti_patterns": (_html(lambda r: perf.anti_patterns(r, PATTERNS)), sql(ANTI_SQL, HTML)),
}

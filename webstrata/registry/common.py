"""The resource tables once more, as SQL, and SQL forms of the token tests."""

from __future__ import annotations

SEP = r"[^\p{L}\p{N}_-]"

MIMES = ("CASE WHEN page_id % 10 = 0 THEN 'image/jpeg' WHEN page_id % 10 = 1 THEN 'application/javascript' "
         "WHEN page_id % 10 = 2 THEN 'text/css' ELSE 'text/html' END")

# page URLs of the given tables carry no media extension, so the MIME type follows from the type alone
PAGES = rf"""
r AS (
  SELECT ('0x' || substr(sha1(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), 1, 12))::BIGINT AS site,
         ('0x' || substr(sha1(url), 1, 12))::BIGINT AS id,
         url,
         CASE WHEN page_id % 10 = 0 THEN 'img' WHEN page_id % 10 = 1 THEN 'script'
              WHEN page_id % 10 = 2 THEN 'style' ELSE 'html' END AS type,
         CASE page_id % 20 WHEN 3 THEN 404 WHEN 4 THEN 301 WHEN 5 THEN 500 WHEN 6 THEN 0 ELSE 200 END::INT AS status,
         strlen(html)::BIGINT AS size,
         (page_id % 500)::INT AS "time",
         'HTTP/1.0 200 OK' || chr(13) || chr(10) || 'Content-Type: ' || {MIMES} || chr(13) || chr(10)
           || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) AS headers,
         html AS content,
         TIMESTAMP '2024-01-01' + to_hours(page_id) AS created,
         TIMESTAMP '2024-01-01' + to_hours(page_id) AS modified
  FROM pages)"""

# the same pages as what they are: all of them HTML, with their content
HTML = PAGES.replace(MIMES, "'text/html'").replace("""CASE WHEN page_id % 10 = 0 THEN 'img' WHEN page_id % 10 = 1 THEN 'script'
              WHEN page_id % 10 = 2 THEN 'style' ELSE 'html' END AS type""", "'html' AS type")
# both at once: r as typed, h as HTML
BOTH = PAGES + "," + HTML.replace("r AS (", "h AS (", 1)

DOCUMENTS = """
r AS (
  SELECT ('0x' || substr(sha1(source), 1, 12))::BIGINT AS site, doc_id AS id,
         'doc://' || source || '/' || doc_id AS url, lang AS type, 200 AS status, n_chars AS size,
         0 AS "time", NULL::VARCHAR AS headers, text AS content
  FROM documents)"""

FIELDS = ("id", "site", "url", "type", "headers", "content")


def has(words: str, fields=FIELDS, prefix: bool = False) -> str:
    """Consecutive tokens in any of the fields."""
    end = "" if prefix else f"($|{SEP})"
    pattern = f"(^|{SEP})" + f"{SEP}+".join(words.split()) + end
    tests = [f"coalesce(regexp_matches(lower({f}::VARCHAR), '{pattern}'), false)" for f in fields]
    return "(" + " OR ".join(tests) + ")"


def sql(select: str, table: str = PAGES, more: str = "") -> str:
    return f"WITH {table}{', ' + more if more else ''} {select}"

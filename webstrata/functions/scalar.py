"""Scalar rules that turn raw paths, headers and log fields into resource columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

WORD = r"\p{L}\p{N}_"


def lookup(values: dict, key: Column) -> Column:
    """Value of a small fixed table, NULL where the key is unknown."""
    def literal(x) -> str:
        return str(x) if isinstance(x, int) else f"'{x}'"

    # one SQL fragment: building the map from single literals takes longer than the lookup
    table = F.expr(f"map({', '.join(literal(x) for item in values.items() for x in item)})")
    return F.try_element_at(table, key)


# ---- identity and URLs

def resource_id(value: Column) -> Column:
    """48-bit identifier: the first 12 hex digits of SHA-1."""
    return F.conv(F.substring(F.sha1(value.cast("binary")), 1, 12), 16, 10).cast("long")


def path_to_url(site: Column, rel: Column) -> Column:
    return F.concat(F.lit("https://"), site, F.lit("/"), F.regexp_replace(rel, r"\\", "/"))


def collapse_index(url: Column) -> Column:
    """``/index.html`` at the end or before a query is the directory itself."""
    return F.regexp_replace(url, r"/index\.html($|\?)", "/$1")


def collapse_index_end(url: Column) -> Column:
    """As above, also for ``.htm``, but only at the very end."""
    return F.regexp_replace(url, r"/index\.html?$", "/")


def clean_asset_url(url: Column) -> Column:
    """Archivers append URL arguments after ``@``; cut them."""
    return F.split_part(url, F.lit("@"), F.lit(1))


def host(url: Column) -> Column:
    """Host of an absolute URL, NULL if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    return F.when(found != "", found)


def scheme(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(found != "", found)


def url_path(url: Column) -> Column:
    """Path of an absolute URL without query and fragment; ``/`` if empty."""
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def path_segment(url: Column, n: int) -> Column:
    """The n-th directory or file name of the URL path (1-based), NULL if there is none."""
    found = F.split_part(url_path(url), F.lit("/"), F.lit(n + 1))
    return F.when(found != "", found)


def display_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^https?://|/$", "")


def strip_wildcards(value: Column) -> Column:
    return F.regexp_replace(value, "^[*\"'`]+|[*\"'`]+$", "")


# ---- file names and types

def extension(path: Column) -> Column:
    """Lower-case suffix of the last path part with its dot, else an empty string."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def decruft_path(path: Column) -> Column:
    """Remove temporary-file marks and junk that mirroring tools leave in names."""
    cleaned = F.regexp_replace(F.lower(path), r"·?\p{Nd}+\.tmp|\p{Nd}{12}|\.tmp", "")
    return F.regexp_replace(cleaned, rf"\.([{WORD}]+)[^{WORD}]*$", r".$1")


def type_from_extension(ext: Column) -> Column:
    return F.coalesce(lookup(S.EXTENSION_TYPES, ext), F.lit("other"))


def type_from_mime(mime: Column) -> Column:
    low = F.lower(F.coalesce(mime, F.lit("")))
    rule = F
    for part, name in S.MIME_TYPES:
        rule = rule.when(low.contains(part), F.lit(name))
    return rule.otherwise(F.lit("other"))


def type_from_log(word: Column, ext: Column) -> Column:
    return F.coalesce(lookup(S.LOG_TYPES, F.lower(word)), type_from_extension(ext))


def is_text(mime: Column) -> Column:
    """Whether a body of this MIME type is worth keeping as text."""
    low = F.lower(F.coalesce(mime, F.lit("")))
    return (F.when(low.startswith("text/"), True)
            .when(low.rlike("^(font|image|audio|video)/|^application/octet-stream"), False)
            .when(low.startswith("application/"), low.isin(S.TEXT_APPLICATION_MIMES))
            .otherwise(True))


def guessed_mime(path: Column) -> Column:
    return lookup(S.known_mimes(), extension(path))


def wants_content(path: Column, type_: Column) -> Column:
    """Whether a mirrored file is text: not binary by name or MIME type, whatever its size."""
    mime = guessed_mime(path)
    textual = mime.isNull() | mime.startswith("text/") | mime.isin(S.TEXT_APPLICATION_MIMES)
    return (~extension(path).isin(S.BINARY_EXTENSIONS) & textual
            & type_.isin("html", "text", "style", "script", "other"))


def decode_text(body: Column) -> Column:
    """UTF-8 text of a file: bad bytes are replaced, line ends unified."""
    return F.regexp_replace(F.make_valid_utf8(body.cast("string")), r"\r\n?", "\n")


# ---- HTTP heads

def basic_headers(size: Column, type_: Column, path: Column) -> Column:
    """A plausible head for files that were stored without one."""
    by_type = F.coalesce(lookup(S.TYPE_MIMES, type_), F.lit(S.DEFAULT_MIME))
    mime = (F.when(type_.isin("img", "audio", "video"),
                   F.coalesce(lookup(S.MEDIA_MIMES, extension(path)), by_type))
            .when(type_ == "other", F.coalesce(guessed_mime(path), F.lit(S.DEFAULT_MIME)))
            .otherwise(by_type))
    return F.concat(F.lit("HTTP/1.0 200 OK\r\nContent-Type: "), mime,
                    F.lit("\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))


def http_status(head: Column) -> Column:
    """Status code of the first header line, 0 if there is none."""
    found = F.regexp_extract(F.split_part(head, F.lit("\n"), F.lit(1)), r"HTTP/\d\.\d\s+(\d+)", 1)
    return F.coalesce(found.try_cast("int"), F.lit(0))


def content_type(head: Column) -> Column:
    return F.trim(F.regexp_extract(head, r"(?i)Content-Type:\s*([^\r\n;]+)", 1))


def headers_text(headers: Column) -> Column:
    """Raw head from a name -> value map; the status line comes from ``Status-Code``."""
    lines = F.transform(
        F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) != "status-code"),
        lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    status = F.coalesce(F.try_element_at(headers, F.lit("Status-Code")), F.lit("200"))
    first = F.array(F.concat(F.lit("HTTP/1.0 "), status))
    return F.when(F.size(headers) > 0,
                  F.concat(F.array_join(F.concat(first, lines), "\r\n"), F.lit("\r\n\r\n")))


# ---- formats

def decode_type(code: Column) -> Column:
    """Type name of an integer code as found in database exports."""
    return lookup(S.TYPE_CODES, code.cast("int"))


def encode_type(name: Column) -> Column:
    """Position of a type name in the type list."""
    return lookup({n: i for i, n in enumerate(S.TYPES)}, name)


def iso_zulu(ts: Column) -> Column:
    """ISO-8601 in UTC with ``Z``; the fraction appears only if it is not zero."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(
        F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == 0, F.lit("")).otherwise(
            F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))),
        F.lit("Z"))


def parse_zulu(value: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(value, "Z", "+00:00"), r"(\.\d{6})\d+", "$1")
    return F.when(value != "", cut).try_cast("timestamp")


def duration_hms(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``"""
    millis = F.floor(seconds * 1000).cast("long")
    whole = F.floor(millis / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600).cast("long"),
                           F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long"),
                           F.pmod(whole, F.lit(60)), F.pmod(millis, F.lit(1000)))


def human_bytes(n: Column) -> Column:
    def tenth(x: Column) -> Column:
        return F.format_string("%.1f", F.bround(x, 1))

    return (F.when(n >= 1024 ** 2, F.concat(tenth(n / 1024 ** 2), F.lit("MB")))
            .when(n >= 1024, F.concat(tenth(n / 1024), F.lit("KB")))
            .otherwise(F.concat(n.cast("string"), F.lit("B"))))


# ---- references

def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on page ``base``, without its fragment."""
    ref = F.regexp_replace(F.trim(ref), "#.*$", "")
    clean = F.regexp_replace(base, "#.*$", "")
    origin = F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    no_query = F.regexp_replace(clean, r"\?.*$", "")
    base_path = F.substr(no_query, F.length(origin) + 1)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path, query = F.regexp_extract(ref, r"^([^?]*)", 1), F.regexp_extract(ref, r"^[^?]*(.*)$", 1)

    def dotless(p: Column) -> Column:
        # the usual case has no dot segment: only the rest pays for the walk over its parts
        last_dot = p.rlike(r"/\.{1,2}$")
        parts = F.aggregate(
            F.split(p, "/"), F.array().cast("array<string>"),
            lambda acc, s: (F.when(s == ".", acc)
                            .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1))
                                  .otherwise(acc))
                            .otherwise(F.concat(acc, F.array(s)))))
        walked = F.concat(F.array_join(parts, "/"), F.when(last_dot, F.lit("/")).otherwise(F.lit("")))
        return F.when(p.rlike(r"/\.{1,2}(/|$)"),
                      F.when(walked.startswith("/"), walked).otherwise(F.concat(F.lit("/"), walked))
                      ).otherwise(p)

    return (F.when(ref == "", clean)
            .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(origin, dotless(path), query))
            .when(ref.startswith("?"), F.concat(no_query, ref))
            .otherwise(F.concat(origin, dotless(F.concat(folder, path)), query)))

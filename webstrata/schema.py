"""Row types of the library and the fixed lookup values they rest on."""

from __future__ import annotations

import mimetypes

from pyspark.sql import types as T

RESOURCE = T.StructType([
    T.StructField("site", T.LongType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("status", T.IntegerType(), False),
    T.StructField("size", T.LongType(), False),
    T.StructField("time", T.IntegerType(), False),
    T.StructField("headers", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("created", T.TimestampType(), True),
    T.StructField("modified", T.TimestampType(), True),
])

SITE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("urls", T.ArrayType(T.StringType()), False),
    T.StructField("path", T.StringType(), True),
    T.StructField("created", T.TimestampType(), True),
    T.StructField("modified", T.TimestampType(), True),
    T.StructField("robots", T.StringType(), True),
])

BASE_FIELDS = ["id", "url", "site", "type", "status"]
OPTIONAL_FIELDS = ["created", "modified", "size", "time", "headers", "content"]

# --- fixed values: the names, codes and limits below must not change, because
# --- results have to agree with archives indexed elsewhere under the same rules.

TYPES = ["", "html", "iframe", "img", "audio", "video", "font", "style",
         "script", "rss", "text", "pdf", "doc", "other"]

TYPE_CODES = {0: "", 1: "html", 2: "other", 3: "rss", 4: "iframe", 5: "other",
              6: "img", 7: "audio", 8: "video", 9: "font", 10: "style",
              11: "script", 12: "other", 13: "text", 14: "pdf", 15: "doc"}

EXTENSION_TYPES = {
    "": "html", ".html": "html", ".htm": "html", ".php": "html", ".asp": "html", ".aspx": "html",
    ".js": "script", ".css": "style",
    ".jpg": "img", ".jpeg": "img", ".png": "img", ".gif": "img", ".svg": "img",
    ".tif": "img", ".tiff": "img", ".webp": "img", ".bmp": "img",
    ".pdf": "pdf", ".txt": "text", ".xml": "text", ".json": "text",
    ".doc": "doc", ".docx": "doc", ".mov": "video", ".mp4": "video",
    ".mp3": "audio", ".ogg": "audio",
}

# substring of the MIME type -> type; the first that fits wins
MIME_TYPES = [("html", "html"), ("javascript", "script"), ("css", "style"), ("image/", "img"),
              ("pdf", "pdf"), ("text/", "text"), ("audio/", "audio"), ("video/", "video"),
              ("application/json", "text"), ("application/xml", "text")]

# words used for the resource type in an exporter's request log
LOG_TYPES = {"html": "html", "redirect": "html", "image": "img", "js": "script", "css": "style",
             "video": "video", "audio": "audio", "pdf": "pdf", "other": "other", "font": "other"}

TYPE_MIMES = {"html": "text/html", "style": "text/css", "script": "application/javascript",
              "img": "image/jpeg", "pdf": "application/pdf", "text": "text/plain",
              "doc": "application/msword", "audio": "audio/mpeg", "video": "video/mp4",
              "other": "application/octet-stream"}
DEFAULT_MIME = "application/octet-stream"

# image, audio and video files take their MIME type from the extension
MEDIA_MIMES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif",
    ".webp": "image/webp", ".svg": "image/svg+xml", ".bmp": "image/bmp", ".ico": "image/x-icon",
    ".tiff": "image/tiff", ".tif": "image/tiff", ".heic": "image/heic", ".heif": "image/heif",
    ".mp3": "audio/mpeg", ".wav": "audio/wav", ".ogg": "audio/ogg", ".flac": "audio/flac",
    ".aac": "audio/aac", ".m4a": "audio/mp4",
    ".mp4": "video/mp4", ".webm": "video/webm", ".avi": "video/x-msvideo",
    ".mov": "video/quicktime", ".mkv": "video/x-matroska",
}

TEXT_APPLICATION_MIMES = [
    "application/json", "application/xml", "application/javascript", "application/atom+xml",
    "application/ld+json", "application/rss+xml", "application/x-www-form-urlencoded",
]

BINARY_EXTENSIONS = [
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".jpeg", ".jpg", ".png", ".webp", ".gif", ".bmp", ".tiff", ".tif", ".svg", ".ico", ".heic", ".heif",
    ".mp3", ".wav", ".ogg", ".flac", ".aac", ".m4a", ".wma",
    ".mp4", ".webm", ".avi", ".mov", ".wmv", ".mkv", ".flv", ".m4v", ".mpg", ".mpeg",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".apk", ".app",
    ".swf", ".svgz", ".dat", ".db", ".sqlite", ".class", ".pyc", ".o",
]

BYTE_UNITS = {"b": 1, "kb": 1024, "mb": 1024 ** 2, "gb": 1024 ** 3}

IGNORED_DIRECTORIES = ["http-client-cache", "result-storage"]
ARCHIVE_SKIPPED_DIRECTORIES = ["media", "mercury"]
WARC_EXTENSIONS = [".warc", ".warc.gz", ".txt"]

DEFAULT_LIMIT = 20

# --- end of fixed values


def known_mimes() -> dict[str, str]:
    """Extension -> MIME of Python's built-in registry, without the host's own mime.types files."""
    return dict(mimetypes.MimeTypes(filenames=()).types_map[True])

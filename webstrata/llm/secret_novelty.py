"""Secrets in text: fixed patterns, and strings in sensitive contexts that a primed compressor cannot shorten.

Three patterns give the base spans: assignments to secret names, access key ids, long hexadecimal runs.  Beside them, a
run of 16 or more characters of the base64, URL and token alphabets becomes a candidate if it mixes letters and
digits, overlaps no base span, and a sensitive word stands before it in the same line, at most 96 characters away.
zstandard is primed with a dictionary of identifiers and given the text around the candidate (without the candidate
itself, wherever it recurs); what the frame grows by when the candidate is appended are its marginal bytes.  Names,
paths and placeholders share pieces with either and shrink; a candidate that keeps four fifths of its length or more is
reported.  A short piece of usual code stands before the text, so that short documents have a context, too.

The identifier dictionary holds letter parts of identifiers near the first sensitive word of a line, by the number of
such lines over all documents, most frequent last, behind a short list of usual ones.  A part is a run of letters between
digits, marks and changes to upper case, so a secret copied into many documents does not enter it as a whole.

Positions are code points of the whole text, ends exclusive.  NULL and empty texts have no spans.  Repeated rows are
judged alike, each for itself.  Other columns pass through ``scanned`` untouched; its result column replaces one of its name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, rows, text_function, texts_of

# fixed values: the base patterns, the least length of each and the group it holds for
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KINDS = [*BASE, "novel"]
SENSITIVE = ["password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api key", "api-key", "access_key", "access key",
             "access-key", "accesskey", "private_key", "private key", "privatekey", "credential", "authorization", "bearer", "signing", "client_id",
             "connectionstring", "jwt"]
USUAL = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "xxxxxxxxxxxxxxxx", "0000000000000000",
         "example", "sample", "dummy", "placeholder", "changeme", "default", "redacted", "test", "your", "config", "settings", "environment", "variable",
         "process", "service", "account", "client", "server", "request", "response", "header", "session", "refresh", "expire", "expires", "expiration",
         "length", "minimum", "maximum", "policy", "reset", "update", "delete", "create", "validate", "generate", "provider", "manager", "handler",
         "factory", "string", "number", "value", "index", "name", "user", "username", "email", "login", "http", "https", "www", "com", "org", "html", "json"]
CODE = """def load_settings(path, environment="production"):
    client = ServiceClient(host=settings.API_HOST, port=8443, timeout=30)  # default account
    for name, value in client.get_parameters(limit=100).items(): os.environ[name.upper()] = str(value)
    return {"user": "admin", "region": "eu-west-1", "version": "2.7.19", "url": "https://www.example.com/v1/items?id=4096"}
"""
LEAST_CHARS = 16
REACH = 96  # characters of a line that a sensitive word looks ahead
AROUND = 1024  # characters of surrounding text on either side
NOVEL_PERCENT = 80
IDENTIFIERS = 4096  # parts in the dictionary
HELD = 100_000  # distinct parts that a task counts before it passes them on
SPANS = "n_assign long, n_access long, n_hex long, base array<string>, spans array<string>"

_BASE_WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
_SENSITIVE_BYTES = [w.encode() for w in SENSITIVE]
_SENSITIVE = re.compile("|".join(map(re.escape, sorted(SENSITIVE, key=len, reverse=True))), re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{%d,}={0,2}" % LEAST_CHARS)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")
_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
_AS_HEX = bytes(0x78 if chr(k) in "0123456789abcdef" else 0x20 for k in range(256))


def base_spans(raw: bytes, text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the base patterns; cheap searches of the bytes tell which patterns can match at all."""
    low = raw.lower()
    may = {"assign": any(w in low for w in _BASE_WORDS), "access": b"AKIA" in raw, "hex": b"x" * 24 in raw.translate(_AS_HEX)}
    return sorted((m.start(), k, m.end()) for k, (kind, (pattern, group, least)) in enumerate(BASE.items()) if may[kind]
                  for m in pattern.finditer(text) if len(m.group(group)) >= least)


def candidates(raw: bytes, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of the strings in sensitive contexts that the base spans leave out."""
    low = raw.lower()
    if not any(w in low for w in _SENSITIVE_BYTES):
        return []
    found: dict[int, int] = {}
    for word in _SENSITIVE.finditer(text):
        line_end = text.find("\n", word.end())
        stop = min(len(text) if line_end < 0 else line_end, word.end() + REACH + 1)
        start = word.end()
        while (m := _CANDIDATE.search(text, start, stop + LEAST_CHARS)) and m.start() < stop:
            found[m.start()] = start = _CANDIDATE.match(text, m.start()).end()
    out, k = [], 0
    for a, b in sorted(found.items()):
        while k < len(base) and base[k][2] <= a:
            k += 1
        mixed = any(c.isdigit() for c in text[a:b]) and any(c.isalpha() for c in text[a:b])
        if mixed and (k == len(base) or base[k][0] >= b):
            out.append((a, b))
    return out


def measure(identifiers: bytes) -> Callable[[str, str], int]:
    """A function from a candidate and the text around it to the candidate's marginal bytes."""
    import zstandard

    params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=3, target_length=64,
                                                 strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    primed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)

    def marginal_bytes(candidate: str, around: str) -> int:
        context = (CODE + around.replace(candidate, " ")).encode()
        return len(primed.compress(context + candidate.encode())) - len(primed.compress(context))
    return marginal_bytes


def novel_spans(raw: bytes, text: str, base: list[tuple[int, int, str]], marginal_bytes: Callable[[str, str], int]) -> list[tuple[int, int, str]]:
    out = []
    for a, b in candidates(raw, text, base):
        if 100 * marginal_bytes(text[a:b], text[max(0, a - AROUND):b + AROUND]) >= NOVEL_PERCENT * (b - a):
            out.append((a, len(BASE), b))
    return out


def joined(spans: list[tuple[int, int, str]]) -> list[str]:
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def identifier_parts(text: str) -> Counter:
    """In how many lines with a sensitive word each part of an identifier stands."""
    seen, done = Counter(), -1
    for word in _SENSITIVE.finditer(text):
        if word.start() < done:
            continue
        start, end = text.rfind("\n", 0, word.start()) + 1, text.find("\n", word.end())
        done = len(text) if end < 0 else end
        near = text[max(start, word.start() - REACH):min(done, word.end() + REACH)]
        seen.update({part.lower() for name in _NAME.findall(near) for part in _PART.findall(name)})
    return seen


def identifier_dictionary(docs: DataFrame, limit: int = IDENTIFIERS) -> bytes:
    """Content that primes the compressor: the ``limit`` most frequent parts, all documents counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in pieces(batches, "text"):
            for raw in texts_of(batch, "text"):
                low = raw.lower()
                if any(w in low for w in _SENSITIVE_BYTES):
                    seen.update(identifier_parts(raw.decode("utf-8", "replace")))
            if len(seen) > HELD:
                yield rows("part string, n long", list(seen), list(seen.values()))
                seen = Counter()
        yield rows("part string, n long", list(seen), list(seen.values()))

    top = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
           .where("n >= 2").orderBy(F.desc("n"), "part").limit(limit).collect())
    return " ".join(USUAL + [r["part"] for r in reversed(top)]).encode()


def scanned(text: Column, identifiers: bytes) -> Column:
    """A struct of the base counts, base spans and all spans of a text column, spans as kind:start:end in order."""

    def build():
        marginal_bytes = measure(identifiers)

        def work(texts: list[bytes]) -> list:
            out = []
            for raw in texts:
                decoded = raw.decode("utf-8", "replace")
                base = base_spans(raw, decoded)
                every = base + novel_spans(raw, decoded, base, marginal_bytes)
                out.append([*(sum(k == kind for _, k, _ in base) for kind in range(len(BASE))), joined(base), joined(every)])
            return [list(column) for column in zip(*out)] or [[]] * 5
        return work

    return text_function(build, SPANS)(text)


def digest(spans: Column) -> Column:
    return F.sha2(F.array_join(spans, ","), 256)


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the digest of the base spans and all spans of every document."""
    found = scanned(F.col("text").cast("string"), identifier_dictionary(docs))
    return (docs.select("doc_id", found.alias("made"))
            .select("doc_id", "made.n_assign", "made.n_access", "made.n_hex", digest(F.col("made.base")).alias("base_sha256"),
                    F.array_join("made.spans", ",").alias("spans")))

"""WARC files: one site per file, one row per response record.

Files are read in ranges of bytes, each by itself.  A range begins at the first record start in it and ends at the first
one behind it, so every record is read once, by the range where it begins.  A record start is a version line followed by
a well-formed head that names the record's type; in packed files it is what a gzip member inflates to.  Packed
files of a single member stay one range.  A body that holds such a head itself, unpacked or stored, could be taken for a
record where a range border falls into it: ``range_bytes=None`` reads every file from its beginning in one piece.

A damaged stretch of a file ends no reading: the stream goes on at the next gzip member, or at the next line that begins a
record.  ``damaged_warc`` gives each stretch as a row.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as N
from .files import BATCH_BYTES, TASK_BYTES, list_level, name_of, open_filesystem, packed
from .table import conform

_RECORD = "name string, url string, date string, head string, mime string, status int, size long, body binary"
_RECORD_ARROW = pa.schema([("name", pa.string()), ("url", pa.string()), ("date", pa.string()), ("head", pa.string()),
                           ("mime", pa.string()), ("status", pa.int32()), ("size", pa.int64()), ("body", pa.binary())])
_DAMAGE = "path string, name string, offset long, reason string"
_DAMAGE_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("offset", pa.int64()), ("reason", pa.string())])
PIECE = 1024 * 1024
MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
VERSION = re.compile(rb"WARC/\d")
_BEGINS = re.compile(rb"(?:\n|\A)(?=WARC/\d)|(?=WARC/\d\.\d{1,3}\r?\n[A-Za-z-]{1,40}:)")
LONGEST_LINE = 1024 * 1024  # of a record's head; a longer one is damage


SLICE = 64 * 1024  # packed bytes inflated at once
RANGE_BYTES = 128 * 1024 * 1024
HEAD_BYTES = 64 * 1024  # of a head by which a record start is told
_START = re.compile(rb"WARC/\d\.\d{1,3}\r?\n(?=(?:[^\n]+\n){0,200}?[Ww][Aa][Rr][Cc]-[Tt][Yy][Pp][Ee]:)(?:[!-9;-~]+:[^\n]*\n|[ \t][^\n]+\n){1,200}?\r?\n")


class Damaged(EOFError):
    """A record that cannot be read to its end."""


class _Stream:
    """The bytes of a file, of its gzip members one after the other if it is packed; reading goes on after ``Damaged``."""

    def __init__(self, raw: BinaryIO, packed: bool, start: int = 0):
        self.raw, self.packed = raw, packed
        if start:
            raw.seek(start)
        self.buffer, self.at, self.passed = b"", 0, 0 if packed else start  # unread bytes from ``at`` on; bytes dropped before the buffer
        self.input, self.taken = b"", start if packed else 0  # packed bytes not inflated yet; file offset behind them
        self.last, self.inflate, self.member = b"", None, 0  # slice inflated before, open member, its offset
        self.inside = False  # in a record
        self.fresh, self.member_from = False, 0  # a member was opened and gave nothing yet; where the open member's bytes begin

    @property
    def offset(self) -> int:
        """Where in the file reading is; of packed files where the member begins."""
        return self.member if self.packed else self.passed + self.at

    def _next_member(self) -> None:
        """After damage: on to the next header of a member behind that of the damaged one."""
        held = self.last + self.input
        held = held[max(0, self.member + 1 - (self.taken - len(held))):]
        self.inflate, self.last = None, b""
        while not (found := MEMBER.search(held)):
            piece = self.raw.read(SLICE)
            if not piece:
                self.input = b""
                return
            self.taken += len(piece)
            held = held[-3:] + piece
        self.input = held[found.start():]

    def _inflated(self) -> bytes:
        while True:
            if len(self.input) < 4 and (piece := self.raw.read(SLICE)):
                self.input, self.taken = self.input + piece, self.taken + len(piece)
            if self.inflate is None:
                self.input = self.input.lstrip(b"\0") if self.input[:1] == b"\0" else self.input  # padding
                if not self.input:
                    if not self.raw.closed and (piece := self.raw.read(SLICE)):
                        self.input, self.taken = piece, self.taken + len(piece)
                        continue
                    return b""
                self.member, self.last = self.taken - len(self.input), b""
                if not MEMBER.match(self.input):
                    self._next_member()
                    raise Damaged("no gzip member begins here")
                self.inflate, first, self.fresh = zlib.decompressobj(31), True, True
            else:
                first = False
                if not self.input and not self.inflate.unconsumed_tail:
                    self._next_member()
                    raise Damaged("gzip member ends early")
            try:
                data = self.inflate.decompress(self.input, PIECE)
            except zlib.error as error:
                self._next_member()
                raise Damaged(f"gzip member: {error}") from None
            if self.inflate.eof:
                self.input, self.inflate = self.inflate.unused_data, None
            else:
                used = len(self.input) - len(self.inflate.unconsumed_tail)
                self.last, self.input = (self.last + self.input[:used])[-SLICE:], self.inflate.unconsumed_tail
            if data:
                if first and self.inside and VERSION.match(data):
                    self.buffer, self.at, self.passed = data, 0, self.passed + len(self.buffer)
                    self.fresh, self.member_from = False, self.passed
                    raise Damaged("record ends before its length")
                return data

    def _more(self) -> bool:
        data = self._inflated() if self.packed else self.raw.read(PIECE)
        self.passed += self.at
        rest, self.at = self.buffer[self.at:], 0
        if self.fresh and data:
            self.fresh, self.member_from = False, self.passed + len(rest)
        self.buffer = rest + data
        return bool(data)

    def read(self, n: int) -> bytes:
        if self.at == len(self.buffer):
            self._more()
        out = self.buffer[self.at:self.at + n]
        self.at += len(out)
        return out

    def readline(self, limit: int = -1) -> bytes:
        most, looked = LONGEST_LINE if limit < 0 else limit, 0
        while (end := self.buffer.find(b"\n", self.at + looked, self.at + most)) < 0:
            looked = len(self.buffer) - self.at
            if looked >= most or not self._more():
                break
        n = min(most, len(self.buffer) - self.at) if end < 0 else end + 1 - self.at
        if end < 0 and limit < 0 and n == most:
            raise Damaged("line without end")
        self.at += n
        return self.buffer[self.at - n:self.at]

    def blank_lines(self) -> bool:
        """Skip white space between records; whether a record, or the end of the file, follows."""
        while True:
            rest = self.buffer[self.at:self.at + 64].lstrip()
            if rest[:6] and (len(rest) >= 6 or not b"WARC/".startswith(rest[:5])):
                self.at += len(self.buffer[self.at:self.at + 64]) - len(rest)
                return bool(VERSION.match(rest))
            if not rest and self.at < len(self.buffer):
                self.at += len(self.buffer[self.at:self.at + 64])
            elif not self._more():
                return not rest

    def ends_here(self) -> bool:
        """Whether the two line ends behind a record come next."""
        while len(self.buffer) - self.at < 4 and self._more():
            pass
        return self.buffer[self.at:self.at + 4] == b"\r\n\r\n"

    def begins_record(self) -> bool:
        """Whether a record start comes next, as a range looks for it."""
        if self.packed and self.passed + self.at != self.member_from:
            return False
        while not _START.match(self.buffer, self.at) and len(self.buffer) - self.at < HEAD_BYTES and (not self.packed or self.inflate):
            if not self._more():
                break
        return bool(_START.match(self.buffer[self.at:self.at + HEAD_BYTES]))

    def next_record(self) -> None:
        """On to the next line that begins a record, or to the end."""
        while not (found := _BEGINS.search(self.buffer, self.at)):
            self.at = max(self.at, len(self.buffer) - 64)
            if not self._more():
                self.at = len(self.buffer)
                return
        self.at = found.end()

    def back(self, offset: int) -> None:
        """Read again from here, in files that are not packed."""
        self.raw.seek(offset)
        self.buffer, self.at, self.passed = b"", 0, offset


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _head(stream: BinaryIO, left: int | None = None) -> tuple[list[bytes], int]:
    """Lines up to the empty one, and how many bytes they took."""
    lines, used = [], 0
    while left is None or used < left:
        line = stream.readline(-1 if left is None else left - used)
        used += len(line)
        if not line.strip():
            break
        lines.append(line.rstrip(b"\r\n"))
    return lines, used


def _pieces(stream: BinaryIO, left: int) -> Iterator[bytes]:
    while left > 0:
        piece = stream.read(min(PIECE, left))
        if not piece:
            raise EOFError("record ends early")
        left -= len(piece)
        yield piece


class _Pull(io.RawIOBase):
    """A readable stream over byte pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            self.rest = next(self.pieces, None)
            if self.rest is None:
                self.rest = b""
                return 0
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _unchunked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    stream = io.BufferedReader(_Pull(pieces))
    while True:
        line = stream.readline()
        try:
            length = int(line.split(b";")[0], 16)
        except ValueError:
            yield line + stream.read()  # not chunked after all
            return
        if not length:
            stream.read()  # trailers, so that the record is used up
            return
        yield stream.read(length)
        stream.readline()


def _inflated(pieces: Iterator[bytes], encoding: str) -> Iterator[bytes]:
    inflate = None
    for piece in pieces:
        if inflate is None:
            window = 31 if encoding == "gzip" else (15 if piece[:1] == b"\x78" else -15)
            inflate = zlib.decompressobj(window)
        yield inflate.decompress(piece)


def _response(stream: BinaryIO, fields: dict[str, str], length: int, is_text) -> dict:
    lines, used = _head(stream, length)
    rest = _pieces(stream, length - used)
    row = {"url": fields.get("warc-target-uri", "").strip("<>") or None, "date": fields.get("warc-date")}
    try:
        http = _fields(lines[1:])
        row["mime"] = http.get("content-type", "")
        status = lines[0].split(None, 2)[1] if lines else b""
        row["status"] = int(status) or 200
        row["head"] = "".join(line.decode("utf-8", "replace") + "\r\n" for line in lines)
        body = rest
        if "chunked" in http.get("transfer-encoding", "").lower():
            body = _unchunked(body)
        if http.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
            body = _inflated(body, http["content-encoding"].lower().removeprefix("x-"))
        if is_text(row["mime"]):
            row["body"] = b"".join(body)
            row["size"] = len(row["body"])
        else:
            row["size"] = sum(len(p) for p in body)
    except (IndexError, ValueError, zlib.error):
        row["url"] = None
    for _ in rest:
        pass
    return row


def _record(stream: _Stream, is_text) -> dict | None:
    """The record that begins here, None if it is no response."""
    stream.readline()
    lines = []
    while (line := stream.readline()).strip():
        lines.append(line.rstrip(b"\r\n"))
    if not line:
        raise Damaged("head without end")
    fields = _fields(lines)
    if not fields.get("content-length", "0").isascii() or not fields.get("content-length", "0").isdecimal():
        raise Damaged("length is no number")
    length = int(fields.get("content-length", "0"))
    if fields.get("warc-type") == "response" and fields.get("content-type", "").startswith("application/http"):
        return _response(stream, fields, length, is_text)
    for _ in _pieces(stream, length):
        pass
    return None


def _member_begins_record(raw: BinaryIO, offset: int) -> bool:
    raw.seek(offset)
    inflate, data = zlib.decompressobj(31), b""
    try:
        while len(data) < HEAD_BYTES and not inflate.eof and (piece := inflate.unconsumed_tail or raw.read(SLICE)):
            data += inflate.decompress(piece, HEAD_BYTES - len(data))
    except zlib.error:
        pass
    return bool(_START.match(data))


def _first_record(raw: BinaryIO, packed: bool, start: int, stop: int) -> int | None:
    """Offset of the first record start from ``start`` on, if it lies before ``stop``."""
    mark = MEMBER if packed else VERSION
    held, at = b"", start
    while at < stop:
        raw.seek(at)
        held = raw.read(SLICE + 8)
        for found in mark.finditer(held[:SLICE + 6]):
            offset = at + found.start()
            if offset >= stop or found.start() >= SLICE:
                break
            if packed:
                right = _member_begins_record(raw, offset)
            else:
                raw.seek(offset)
                right = bool(_START.match(raw.read(HEAD_BYTES)))
            if right:
                return offset
        if len(held) <= SLICE:
            return None
        at += SLICE
    return None


def _records(stream: _Stream, is_text, stop: float = float("inf")) -> Iterator[dict]:
    """Response records, and a row with offset and reason for each damaged stretch, which ends at the next record.

    Ends at the first record start at ``stop`` or behind it.
    """
    follows = False
    while True:
        start, row = stream.offset, None
        try:
            if not follows and not stream.blank_lines():
                start = stream.offset
                yield {"offset": start, "reason": "no record begins here"}
                stream.next_record()
            if stream.at == len(stream.buffer):
                if not stream._more():
                    return
            start, begin = stream.offset, stream.passed + stream.at
            if start >= stop and stream.begins_record():
                return
            stream.inside = True
            row = _record(stream, is_text)
            stream.inside, follows = False, False
            ended = stream.packed or stream.ends_here()
            follows = stream.blank_lines()
            if row is not None and not row["url"] and not stream.packed:
                raise Damaged("response cannot be read")
            if not follows and not ended:
                raise Damaged("record does not end at its length")
            if row is not None:
                yield row if row["url"] else {"offset": start, "reason": "response cannot be read"}
        except EOFError as error:
            if row is not None and not stream.inside and stream.packed:  # the damage lies behind this record
                yield row if row["url"] else {"offset": start, "reason": "response cannot be read"}
                start = stream.offset
            yield {"offset": start, "reason": str(error)}
            follows, at_record = False, stream.inside
            stream.inside = False
            if not stream.packed:
                stream.back(begin + 5)
            try:
                if not (stream.packed and VERSION.match(stream.buffer, stream.at) and at_record):
                    stream.next_record()
            except EOFError as again:
                yield {"offset": stream.offset, "reason": str(again)}


def _textual(mime: str) -> bool:
    low = mime.lower()
    if low.startswith("application/"):
        return low in S.TEXT_APPLICATION_MIMES
    return not low.startswith(("font/", "image/", "audio/", "video/"))


def _read_into(schema: pa.Schema, wanted):
    """Rows of the files that are wanted, in batches of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "start", "stop"))):
                rows, held = [], 0
                system, inside = open_filesystem(path)
                packed = path.endswith(".gz")
                with system.open_input_file(inside) as raw:
                    first = _first_record(raw, packed, start, stop) if start else 0
                    if first is None:
                        continue
                    raw.seek(0)
                    for row in _records(_Stream(raw, packed, first), _textual, stop):
                        if not wanted(row):
                            continue
                        rows.append({"path": path, "name": name, **row})
                        held += len(row.get("body") or b"") + 1024
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def record_time(date: Column) -> Column:
    """ISO-8601, then the mail format; NULL for a date that is neither."""
    mail = F.regexp_replace(F.regexp_replace(date, r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|Z)$", "+0000")
    return F.coalesce(N.parse_zulu(date), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def warc_files(spark: SparkSession, root: str) -> DataFrame:
    ends = F.lit(False)
    for ext in S.WARC_EXTENSIONS:
        ends = ends | F.col("path").endswith(ext)
    return list_level(spark, root).where(~F.col("folder") & ends).withColumn("name", name_of(F.col("path")))


def _ranges(spark: SparkSession, root: str, partitions: int | None, range_bytes: int | None) -> DataFrame:
    """path, name, start and stop of what is read at once, in tasks of about equal bytes."""
    files, whole = warc_files(spark, root).select("path", "name", "length"), F.lit((1 << 63) - 1)
    if range_bytes is None:
        ranges = files.select("path", "name", F.lit(0).cast("long").alias("start"), whole.alias("stop"), F.col("length").alias("bytes"))
    else:
        starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))
        each = files.select("path", "name", "length", F.explode(starts).alias("start"))
        stop = F.col("start") + F.lit(range_bytes)
        ranges = each.select("path", "name", "start", F.when(stop >= F.col("length"), whole).otherwise(stop).alias("stop"),
                             F.least(F.col("length") - F.col("start"), F.lit(range_bytes)).alias("bytes"))
    if partitions:
        return ranges.repartition(partitions, "path", "start")
    return packed(ranges, F.col("bytes"), ["path", "start"], range_bytes or TASK_BYTES)


def read_warc(spark: SparkSession, root: str, partitions: int | None = None, range_bytes: int | None = RANGE_BYTES) -> DataFrame:
    """Response records of all WARC files in a folder; a file is read in ranges by several tasks."""
    ranges = _ranges(spark, root, partitions, range_bytes)
    rows = ranges.mapInArrow(_read_into(_RECORD_ARROW, lambda row: "url" in row), _RECORD)
    mime = F.col("mime")
    valid = F.is_valid_utf8(F.col("body").cast("string"))
    return conform(rows.select(
        N.resource_id(F.col("name")).alias("site"), N.resource_id(F.col("url")).alias("id"), "url",
        N.type_from_mime(mime).alias("type"), "status", "size", F.lit(0).alias("time"), F.col("head").alias("headers"),
        F.when(valid & N.is_text(mime), F.col("body").cast("string")).alias("content"),
        record_time(F.col("date")).alias("created"), record_time(F.col("date")).alias("modified")))


def damaged_warc(spark: SparkSession, root: str, partitions: int | None = None, range_bytes: int | None = RANGE_BYTES) -> DataFrame:
    """Damaged stretches of all WARC files in a folder: file, offset (of packed files that of the member) and reason."""
    ranges = _ranges(spark, root, partitions, range_bytes)
    return ranges.mapInArrow(_read_into(_DAMAGE_ARROW, lambda row: "reason" in row), _DAMAGE)

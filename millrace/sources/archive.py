"""Archives of web requests, of any size, read by byte ranges as a Python data source.

An archive is a file of JSON records, one a line, or a browser's log as HAR, indented. As JSON has no line feed inside a
text, a record begins at a line that begins one: any line of the first kind, and of the second the lines that are indented
as its entries are. A range reads the records that begin in it, to their end behind it.
"""

from __future__ import annotations

import base64
import gzip
import json
import operator
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains,
    StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

REQUEST = "url string, method string, headers map<string,string>, body string, status int, response_body string"
#: A record's file and first byte order all records; ``broken`` is the text of one that is no JSON record.
ARCHIVE = f"file string, offset long, {REQUEST}, broken string"
SCHEMA = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("method", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string()), ("status", pa.int32()),
    ("response_body", pa.string()), ("broken", pa.string()),
])
#: Bytes read at once, of a range, of a batch of records, and of a file's beginning that tells its kind.
READ, SPLIT, BATCH, HEAD = 1 << 20, 64 << 20, 4 << 20, 1 << 20
#: Where the entries of an indented HAR begin, and how they are indented.
ENTRIES = re.compile(rb'\n[ \t]*"entries"[ \t]*:[ \t]*\[[ \t]*\r?\n([ \t]*)\{')


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:/", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)


class Range(InputPartition):
    """Records of ``path`` that begin from ``start`` to before ``end``: at lines that begin with ``lead``; with none at any."""

    def __init__(self, path: str, start: int, end: int, lead: bytes | None, whole: bool = False) -> None:
        super().__init__(path)
        self.path, self.start, self.end, self.lead, self.whole = path, start, end, lead, whole


class RequestArchive(DataSource):
    """``path``: a file, or a folder of them; ``split``: bytes of a range. Compressed files, and HAR without line feeds, are a range each."""

    @classmethod
    def name(cls) -> str:
        return "request_archive"

    def schema(self) -> str:
        return ARCHIVE

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split", SPLIT)))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        if split < 1:
            raise ValueError("a range has at least one byte")
        self.path, self.split = path, split
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the conditions on url, method, status and offset; they are tested before a row is made."""
        for f in filters:
            if known(f):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, path = opened(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File), key=lambda f: f.path)
        out: list[Range] = []
        for f in found:
            if f.base_name.startswith((".", "_")) or not f.size:
                continue
            out += self.ranges(store, f)
        return out

    def ranges(self, store: fs.FileSystem, f: fs.FileInfo) -> list[Range]:
        if f.extension in ("gz", "bz2", "zst"):
            return [Range(f.path, 0, f.size, None, True)]
        with store.open_input_file(f.path) as file:
            head = file.read(HEAD)
        lead = None
        if re.match(rb'\s*\{\s*"log"', head):
            told = ENTRIES.search(head)
            if not told:
                return [Range(f.path, 0, f.size, None, True)]
            lead = told[1] + b"{"
        return [Range(f.path, at, min(at + self.split, f.size), lead) for at in range(0, f.size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for offset, raw in self.records(partition):
            if self.tests and not possible(self.tests, raw):
                continue
            for row in parsed(partition.path, offset, raw):
                if all(holds(t, row) for t in self.tests):
                    rows.append(row)
            held += len(raw)
            if held > BATCH or len(rows) >= 1000:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    def records(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """First byte and text of each record of a range."""
        store, _ = opened(self.path)
        if part.whole:
            with store.open_input_stream(part.path) as stream:
                text = stream.read()
            if text[:2] == b"\x1f\x8b":  # told by another ending
                text = gzip.decompress(text)
            if re.match(rb'\s*\{\s*"log"', text):
                yield 0, text
            else:
                at = 0
                for line in text.splitlines(keepends=True):
                    if line.strip():
                        yield at, line
                    at += len(line)
            return
        with store.open_input_file(part.path) as file:
            open_at, held = None, []
            for offset, line in lines(file, part.start):
                begins = bool(line.strip()) if part.lead is None else line.startswith(part.lead)
                if begins:
                    if open_at is not None:
                        yield open_at, b"".join(held)
                    if offset >= part.end:
                        return
                    open_at, held = offset, []
                elif offset >= part.end and open_at is None:
                    return  # no record begins here; one of an earlier range reaches over all of it
                if open_at is not None:
                    held.append(line)
            if open_at is not None:
                yield open_at, b"".join(held)


def lines(file: pa.NativeFile, start: int) -> Iterator[tuple[int, bytes]]:
    """The lines that begin at ``start`` or later, each with its first byte, read READ bytes at a time."""
    at = max(0, start - 1)  # the byte before tells whether a line begins at ``start``
    file.seek(at)
    pieces: list[bytes] = []
    skip = start > 0
    while chunk := file.read(READ):
        parts = chunk.split(b"\n")
        for k, piece in enumerate(parts):
            pieces.append(piece if k == len(parts) - 1 else piece + b"\n")
            if k < len(parts) - 1:
                line = b"".join(pieces)
                if not skip:
                    yield at, line
                at, pieces, skip = at + len(line), [], False
    if any(pieces) and not skip:
        yield at, b"".join(pieces)


def text_of(x: object) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def parsed(path: str, offset: int, raw: bytes) -> Iterator[dict]:
    """The rows of a record's text; what follows its end, a comma or the end of a list, doesn't count."""
    none = dict.fromkeys(SCHEMA.names) | {"file": path, "offset": offset}
    text = raw.decode("utf-8", "replace")
    try:
        record, _ = json.JSONDecoder().raw_decode(text.lstrip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        record = None
    if not isinstance(record, dict):
        yield none | {"broken": text}
    elif isinstance(record.get("log"), dict):
        for k, entry in enumerate(record["log"].get("entries") or []):
            yield none | {"offset": k} | har_row(entry)
    elif isinstance(record.get("request"), dict):
        yield none | har_row(record)
    elif "url" in record:
        headers = record.get("headers")
        status = record.get("status")
        yield none | {
            **{c: text_of(record.get(c)) for c in ("url", "method", "body", "response_body")}, "status": status if isinstance(status, int) and abs(status) < 2**31 else None,
            "headers": [(k, text_of(v)) for k, v in headers.items()] if isinstance(headers, dict) else None,
        }
    # other records, such as a HAR's pages, are no requests


def har_row(entry: dict) -> dict:
    """An entry of a HAR as a request; of its answer's headers the type alone is taken."""
    request, answer = entry.get("request") or {}, entry.get("response") or {}
    content = answer.get("content") or {}
    headers = {str(h.get("name")).lower(): text_of(h.get("value")) for h in request.get("headers") or [] if isinstance(h, dict)}
    headers.pop("content-type", None)
    if content.get("mimeType"):
        headers["content-type"] = text_of(content["mimeType"])
    body = content.get("text")
    if isinstance(body, str) and content.get("encoding") == "base64":
        try:
            body = base64.b64decode(body, validate=True).decode("utf-8", "replace")
        except ValueError:
            pass
    status = answer.get("status")
    return {
        "url": text_of(request.get("url")), "method": text_of(request.get("method")), "headers": list(headers.items()), "body": text_of((request.get("postData") or {}).get("text")),
        "status": status if isinstance(status, int) and 0 < status < 2**31 else None, "response_body": text_of(body),
    }


def batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in SCHEMA], schema=SCHEMA)


COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
TEXT = {StringContains: lambda a, b: b in a, StringStartsWith: str.startswith, StringEndsWith: str.endswith}


def known(f: Filter) -> bool:
    """Whether a condition is one that ``holds`` decides as Spark does."""
    if isinstance(f, Not):
        return known(f.child)
    kinds = (*COMPARED, *TEXT, EqualNullSafe, In, IsNull, IsNotNull)
    if not isinstance(f, kinds) or len(f.attribute) != 1 or f.attribute[0] not in ("url", "method", "status", "offset"):
        return False
    order = isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
    return not (order and f.attribute[0] in ("url", "method"))  # Spark compares the bytes of texts


def truth(f: Filter, row: dict) -> bool | None:
    """True, false, or null, by SQL's rules."""
    if isinstance(f, Not):
        inner = truth(f.child, row)
        return None if inner is None else not inner
    x = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return x is None
    if isinstance(f, IsNotNull):
        return x is not None
    if isinstance(f, EqualNullSafe):
        return x == f.value
    if isinstance(f, In):
        return None if x is None else True if x in f.value else None if None in f.value else False
    return None if x is None or f.value is None else bool((COMPARED | TEXT)[type(f)](x, f.value))


def holds(f: Filter, row: dict) -> bool:
    return truth(f, row) is True


def possible(tests: list[Filter], raw: bytes) -> bool:
    """False only where a record's text lacks letters that a condition asks for, so it needn't be parsed; escapes could hide them."""
    for f in tests:
        if isinstance(f, (EqualTo, *TEXT)) and isinstance(f.value, str):
            for part in re.findall("[A-Za-z0-9]{3,}", f.value):
                if part.encode() not in raw and b"\\u" not in raw:
                    return False
    return True

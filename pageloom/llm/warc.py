"""WARC archives of pages with a two-level capture index.

Writing: pages are reduced to rows of id, address and payload digest; of records with equal payloads of ``least_bytes`` bytes or
more, the one of largest page id becomes the response and the others revisit it; smaller payloads are all written. One copy of each
payload travels to the task that writes its response, revisits are written from the narrow rows. Every record is a gzip member of its
own, so it can be read by its range alone.

Index: captures are sorted by a key of reversed host, path and query over all tasks. Each task writes one index file: compressed
blocks of ``BLOCK_LINES`` captures, then a sparse directory with the first and last key and the range of each block. A lookup finds the
index file and the block by binary search, reads that block's range, searches inside it, and hands over ranges of records, which
are read in order of place, neighbouring ones at once.

Files go to a folder all executors reach (any address that Arrow's file systems know). A task writes files under names of its own;
only files of the attempt whose rows Spark keeps are referred to, so lost executors leave unused files and no wrong ones.

Null html is an empty payload; a null url has the empty key; a null page id is less than any other. A row that stands several
times is one response and revisits of it. Rows without pages make an empty archive and no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import bounded_batches, give_back, materialize

#: Captures in a block of the index.
BLOCK_LINES = 1024
#: Bytes after which an archive file is closed, and bytes read at once when records lie side by side.
ROLL_BYTES, READ_BYTES = 1 << 30, 4 << 20
#: Repetitions of one row written by one task at a time.
COPIES = 1000

RESPONSE, REVISIT = "response", "revisit"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TAIL = "<QQ"
_PRINTABLE = "".join(chr(c) for c in range(33, 127))
_ID = re.compile(rb"<urn:x-page:(-?\d*):")

CAPTURES = "key string, page_id bigint, file string, offset bigint, length bigint"
FILES = "file string, first string, last string, blocks bigint, lines bigint"
PAGES = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: ``http://Sub.a.com/x?y#z`` is ``com,a,sub)/x?y``. Other texts are their own key."""
    whole = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)"
    host, rest = F.lower(F.regexp_extract(url, whole, 1)), F.regexp_extract(url, whole, 2)
    names = F.array_join(F.reverse(F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")), ",")
    key = F.concat(names, F.regexp_extract(host, r"(:\d+)$", 1), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.coalesce(F.when(host != "", key).otherwise(url), F.lit(""))


def base32_of(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers: tuple | None, date: str, copy: int) -> bytes:
    """One record; a revisit carries the head of the answer only, which states the payload's length."""
    name = lambda i, n: f"<urn:x-page:{'' if i is None else i}:{digest}:{n}>"
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id, copy)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'urn:x-none', safe=_PRINTABLE)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(answer)}",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers[0], 0)}", f"WARC-Refers-To-Target-URI: {quote(refers[1] or 'urn:x-none', safe=_PRINTABLE)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + answer + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page id, payload bytes, digest, record type, page id referred to) of a record; a response's payload is checked."""
    head, body = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    answer = body[: int(fields[b"Content-Length"])]
    http, payload = answer.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    number = lambda text: int(m[1]) if (m := _ID.match(text)) and m[1] else None
    page, kind = number(fields[b"WARC-Record-ID"]), fields[b"WARC-Type"].decode()
    if kind == REVISIT:
        return page, size, digest, kind, number(fields[b"WARC-Refers-To"])
    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"damaged record of page {page}")
    return page, size, digest, kind, None


class _Archive:
    """Files of one task, closed when large; ``add`` returns where a record stands."""

    def __init__(self, folder: str, roll_bytes: int) -> None:
        self.folder, self.roll_bytes, self.out, self.at, self.name = folder, roll_bytes, None, 0, ""

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.roll_bytes:
            self.close()
            self.name, self.at = f"archive-{uuid.uuid4().hex}.warc.gz", 0
            store, path = fs.FileSystem.from_uri(self.folder)
            self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
            told = "software: pageloom\r\nformat: WARC File Format 1.1\r\n"
            self._put(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {_now()}\r\n"
                      f"Content-Type: application/warc-fields\r\nContent-Length: {len(told)}\r\n\r\n{told}\r\n\r\n".encode())
        start = self.at
        return self.name, start, self._put(raw)

    def _put(self, raw: bytes) -> int:
        member = gzip.compress(raw, 6, mtime=0)
        self.out.write(member)
        self.at += len(member)
        return len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _distinct_payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload once per task, with its digest; a task holds the digests of its own rows."""
    met: set[bytes] = set()
    for batch in batches:
        payloads = batch.column(0).cast(pa.large_binary())
        digests, keep = [], []
        for i, payload in enumerate(payloads):
            digest = hashlib.sha1(payload.as_buffer()).digest()
            if digest not in met:
                met.add(digest)
                digests.append(digest.hex())
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), payloads.take(pa.array(keep, pa.int64())).cast(pa.binary())], names=["digest", "payload"])


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages' records to ``folder`` and return their captures (``CAPTURES``), one per page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    html = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    narrow = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.make_valid_utf8(F.col(f"`{url_col}`")).alias("url"),
        F.sha1(html).alias("digest"), F.octet_length(html).cast("bigint").alias("bytes"))
    rows = materialize(narrow.groupBy("page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("n")))
    first = rows.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"))
    is_first = F.struct("page_id", "url").eqNullSafe(F.col("first"))
    part = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.alias("n"))
    none, all_of = F.lit(0).cast("bigint"), F.col("n")
    parts = F.when(F.col("bytes") < least_bytes, F.array(part(RESPONSE, all_of), part(REVISIT, none))).when(
        is_first, F.array(part(RESPONSE, none + 1), part(REVISIT, all_of - 1))).otherwise(F.array(part(RESPONSE, none), part(REVISIT, all_of)))
    told = rows.join(first, "digest").withColumn("part", F.explode(parts)).filter("part.n > 0")
    run = F.explode(F.sequence(none, F.floor((F.col("part.n") - 1) / COPIES)))
    told = told.withColumn("run", run).select(
        "page_id", "url", "digest", "bytes", "first", "run", F.col("part.kind").alias("kind"), url_key(F.col("url")).alias("key"),
        F.least(F.col("part.n") - F.col("run") * COPIES, F.lit(COPIES)).alias("n"))
    payloads = pages.select(html.alias("payload")).mapInArrow(_distinct_payloads, "digest string, payload binary")
    payloads = payloads.groupBy("digest").agg(F.any_value("payload").alias("payload"))
    responses = told.filter(F.col("kind") == RESPONSE).join(payloads, "digest")
    revisits = told.filter(F.col("kind") == REVISIT).repartition("digest", "page_id", "url", "run").withColumn("payload", F.lit(None).cast("binary"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, date = _Archive(folder, ROLL_BYTES), _now()
        names = ("key", "page_id", "file", "offset", "length")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                made: list[tuple] = []
                for r in batch.slice(at, 64).to_pylist():
                    refers = (r["first"]["page_id"], r["first"]["url"]) if r["kind"] == REVISIT else None
                    for i in range(r["n"]):
                        copy = r["run"] * COPIES + i + (refers is not None)
                        raw = record(r["kind"], r["page_id"], r["url"], base32_of(r["digest"]), r["bytes"], r["payload"], refers, date, copy)
                        made.append((r["key"], r["page_id"], *out.add(raw)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=list(names))
        out.close()
        give_back()

    order = ["page_id", "url", "digest", "bytes", "first", "run", "kind", "key", "n", "payload"]
    return materialize(responses.select(*order).mapInArrow(write, CAPTURES)).unionByName(materialize(revisits.select(*order).mapInArrow(write, CAPTURES)))


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted index of the captures to ``folder``; its files in order (``FILES``), one per task.

    Every capture's line is a JSON list: key, page id, file, offset, length.
    """
    captures = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, out, at, lines = f"index-{uuid.uuid4().hex}.gz", None, 0, 0
        directory: list[tuple] = []
        held: list[list] = []

        def put() -> None:
            nonlocal at, held
            block = gzip.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in held).encode(), 6, mtime=0)
            out.write(block)
            directory.append((held[0][0], held[-1][0], at, len(block)))
            at, held = at + len(block), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                held.append(list(row))
                lines += 1
                if len(held) == block_lines:
                    put()
        if out is not None:
            if held:
                put()
            packed = gzip.compress(json.dumps(directory, ensure_ascii=False).encode(), 6, mtime=0)
            out.write(packed + struct.pack(_TAIL, at, len(packed)))
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first": directory[0][0], "last": directory[-1][1], "blocks": len(directory), "lines": lines}])

    return materialize(captures.mapInArrow(write, FILES))


class IndexFile:
    """Lookups in one index file: the directory is read once, blocks by range, the last one is kept."""

    def __init__(self, folder: str, name: str) -> None:
        store, path = fs.FileSystem.from_uri(folder)
        self.source = store.open_input_file(f"{path}/{name}")
        size = self.source.size()
        at, length = struct.unpack(_TAIL, self.source.read_at(16, size - 16))
        self.directory = json.loads(gzip.decompress(self.source.read_at(length, at)))
        self.last = [d[1] for d in self.directory]
        self.number, self.block, self.keys = -1, [], []

    def find(self, key: str) -> Iterator[list]:
        """The captures of a key, in order."""
        at = bisect.bisect_left(self.last, key)
        while at < len(self.directory) and self.directory[at][0] <= key:
            if at != self.number:
                _, _, start, length = self.directory[at]
                lines = gzip.decompress(self.source.read_at(length, start)).decode().split("\n")[:-1]
                self.number, self.block = at, [json.loads(x) for x in lines]
                self.keys = [x[0] for x in self.block]
            yield from self.block[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]
            at += 1

    def close(self) -> None:
        self.source.close()


def look_up(files: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """Captures (``CAPTURES``) of the distinct ``keys`` (column ``key``).

    The driver holds one row per index file, that is per task of the sort. A key goes to each file whose range holds it, so the
    captures of a frequent key are found by several tasks.
    """
    listed = sorted((r["first"], r["last"], r["file"]) for r in files.collect())
    firsts, lasts, names = ([x[i] for x in listed] for i in range(3))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                (key, names[i]) for key in batch.column(0).to_pylist()
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.string()), pa.array([n for _, n in made], pa.string())], names=["key", "index"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, index = None, None
        for batch in batches:
            for wanted, key in zip(batch.column("index").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if wanted != name:
                    if index is not None:
                        index.close()
                    name, index = wanted, IndexFile(folder, wanted)
                some: list[list] = []
                for found in index.find(key):
                    some.append(found)
                    if len(some) == BLOCK_LINES:
                        yield _captures(some)
                        some = []
                if some:
                    yield _captures(some)
        if index is not None:
            index.close()

    asked = keys.select("key").filter("key is not null").distinct().mapInArrow(dealt, "key string, index string")
    return asked.repartition("index").sortWithinPartitions("index", "key").mapInArrow(search, CAPTURES)


def _captures(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "page_id", "file", "offset", "length"])


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records at the captures' ranges (``PAGES``), each checked against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(places):
                file, start, length = places[at]
                to = at + 1
                while to < len(places) and places[to][0] == file and places[to][1] == start + length and length + places[to][2] <= READ_BYTES:
                    length += places[to][2]
                    to += 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{path}/{file}")
                raw = source.read_at(length, start)
                made = [parse(gzip.decompress(raw[o - start : o - start + n])) for _, o, n in places[at:to]]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                at = to
        if source is not None:
            source.close()
        give_back()

    stretch = F.floor(F.col("offset") / (64 << 20)).alias("stretch")
    dealt = captures.select("file", "offset", "length", stretch).repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, PAGES)


def archive_round_trip(pages: DataFrame, folder: str, least_bytes: int = 0, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the pages, index the captures, look every page's address up and read its records back."""
    captures = write_archive(pages, folder, least_bytes)
    files = build_index(captures, folder, block_lines)
    keys = pages.select(url_key(F.make_valid_utf8("url")).alias("key"))
    return read_records(look_up(files, folder, keys), folder)

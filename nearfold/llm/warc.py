"""WARC archives with revisit records, and a two-level index of their captures.

``write`` makes one gzip member per record (WARC/1.1) and returns the captures.
``build_index`` sorts captures by reversed-host URL key into index files of compressed
blocks; each file ends with a sparse directory, one entry per block, and the table of
files has each file's first and last key. ``lookup`` binary-searches the table, then the
directory, and range-reads one block after the other and the records they name.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from nearfold.llm.files import attempt_file, in_ranges, place
from nearfold.plans.storage import fresh_dir, written

LEVEL = 3
BLOCK_LINES = 1000
BATCH_ROWS = 10_000
READ_GAP = 1 << 16
READ_BYTES = 4 << 20
FOOTER = struct.Struct("<QI")  # where the directory begins, and its length
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "surt string, page_id long, path string, at long, size long"
RECORD = "surt string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, scheme, port 80/443, user and fragment left out; "" for null."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One WARC record; ``first`` is the page that a revisit refers to, null for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if first is not None else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else "urn:nearfold:no-target"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page: {first}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC header, the HTTP header and the payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write(
    pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """A record for each page, payload its text in UTF-8 (null: empty); returns the captures.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is
    a response (all rows of that id, if it repeats) and the others are revisits of it; smaller
    payloads are responses. Null ids come after all others: they are revisits if any id has the payload,
    responses else. Null URLs get the key "". Other columns are ignored, no pages give no records.
    """
    folder = fresh_dir(pages.sparkSession, "warc")
    data = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        data.alias("html"),
        F.sha1(F.encode(data, "UTF-8")).alias("sha1"),
    )
    # only digests and ids meet by digest; payloads are dealt by id and digest, so equal payloads are spread over all tasks
    keys = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "sha1")
    groups = keys.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("first is not null and n > 1")
    revisits = keys.distinct().join(written(groups.select("sha1", "first"), "payloads").hint("merge"), "sha1").where("not page_id <=> first")
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "first")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1"))
    told = rows.join(revisits.hint("merge"), same, "left").select("page_id", "url", "html", "sha1", "first")

    def run(batches):
        stream, path, at = None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                system, local, path = attempt_file(folder, f"part-{TaskContext.get().partitionId():06d}", ".warc.gz")
                stream = system.open_output_stream(local, compression=None)
            found = []
            for page_id, url, html, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                packed = gzip.compress(record(page_id, url, html.encode(), digest, first, date), LEVEL, mtime=0)
                stream.write(packed)
                found.append((surt(url), page_id, path, at, len(packed)))
                at += len(packed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["surt", "page_id", "path", "at", "size"],
            )
        if stream is not None:
            stream.close()

    return written(told.mapInArrow(run, CAPTURE), "captures")


def build_index(captures: DataFrame) -> DataFrame:
    """Writes the index files; returns the table of files (path, first key, last key, lines)."""
    folder = fresh_dir(captures.sparkSession, "index")

    def run(batches):
        stream, path, at, directory, lines, last, total = None, "", 0, [], [], "", 0

        def block():
            nonlocal at
            packed = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            directory.append([lines[0].split("\t", 1)[0], at, len(packed)])
            stream.write(packed)
            at += len(packed)
            lines.clear()

        for batch in batches:
            if batch.num_rows and stream is None:
                system, local, path = attempt_file(folder, f"part-{TaskContext.get().partitionId():06d}", ".cdx")
                stream = system.open_output_stream(local, compression=None)
            for key, page_id, file, place_, size in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(f"{key}\t{json.dumps([page_id, file, place_, size])}")
                last, total = key, total + 1
                if len(lines) == BLOCK_LINES:
                    block()
        if stream is not None:
            if lines:
                block()
            sparse = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
            stream.write(sparse + _footer(at, len(sparse)))
            stream.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first": directory[0][0], "last": last, "lines": total}])

    ordered = captures.select(F.translate("surt", "\t\n", "  ").alias("surt"), "page_id", "path", "at", "size")
    ordered = ordered.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    return written(ordered.mapInArrow(run, "path string, first string, last string, lines long"), "index")


def _footer(at: int, size: int) -> bytes:
    return FOOTER.pack(at, size)


class IndexFile:
    """One index file: its sparse directory in memory, its blocks on demand."""

    def __init__(self, uri: str):
        system, path = place(uri)
        self.file = system.open_input_file(path)
        end = self.file.size() - FOOTER.size
        at, size = FOOTER.unpack(self.file.read_at(FOOTER.size, end))
        self.directory = json.loads(gzip.decompress(self.file.read_at(size, at)))
        self.keys = [d[0].encode() for d in self.directory]
        self.block, self.names, self.number = [], [], -1

    def _read(self, number: int) -> None:
        if number != self.number:  # sorted keys ask for each block once
            _, at, size = self.directory[number]
            text = gzip.decompress(self.file.read_at(size, at)).decode()
            self.block, self.number = [x.split("\t", 1) for x in text.split("\n")], number
            self.names = [x[0].encode() for x in self.block]

    def captures(self, key: str) -> Iterator[tuple[str, int | None, str, int, int]]:
        """The captures of a key: the directory is searched, then the blocks that may hold the key."""
        code = key.encode()
        b = max(bisect.bisect_left(self.keys, code) - 1, 0)  # a key may begin at the end of the block before
        while b < len(self.keys) and self.keys[b] <= code:
            self._read(b)
            i = bisect.bisect_left(self.names, code)
            while i < len(self.block) and self.names[i] == code:
                yield key, *json.loads(self.block[i][1])
                i += 1
            b += 1


def _records(found: list[tuple[str, int | None, str, int, int]]) -> Iterator[tuple]:
    """The records of captures; those that lie close together in a file are read in one range."""
    found.sort(key=lambda x: (x[2], x[3]))
    i, name, file = 0, None, None
    while i < len(found):
        j, end = i + 1, found[i][3] + found[i][4]
        while j < len(found) and found[j][2] == found[i][2] and found[j][3] - end <= READ_GAP and found[j][3] - found[i][3] <= READ_BYTES:
            end = found[j][3] + found[j][4]
            j += 1
        if found[i][2] != name:
            system, path = place(name := found[i][2])
            file = system.open_input_file(path)
        raw = file.read_at(end - found[i][3], found[i][3])
        for key, page_id, _, at, size in found[i:j]:
            member = raw[at - found[i][3] : at - found[i][3] + size]
            warc, http, payload = parse(zlib.decompress(member, wbits=31))
            digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
            full = int(http["Content-Length"])
            if warc["WARC-Type"] == "response":
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != full:
                    raise ValueError(f"record at {at} of {name} does not match its digest")
            page = warc.get("X-Page-Id")
            first = warc.get("X-Refers-To-Page")
            yield key, page and int(page), full, digest, warc["WARC-Type"], first and int(first)
        i = j


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The records of every capture whose key is in the column ``surt`` of ``keys``, read from the archives.

    Keys are dealt to the index files that may hold them, their captures to the archives; both in sorted order, so
    a task holds one block of an index file, or one range of an archive, and BATCH_ROWS captures at a time, however many a key has.
    """
    keys = keys.select(F.translate("surt", "\t\n", "  ").alias("surt")).where("surt is not null").distinct()
    asked = in_ranges(keys, "surt", index)

    def asked_captures(batches):
        name, file = None, None
        for batch in batches:
            for path, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path != name:
                    name, file = path, IndexFile(path)
                yield from file.captures(key)

    def places(batches):
        found = asked_captures(batches)
        while some := list(islice(found, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*some), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["surt", "page_id", "path", "at", "size"],
            )

    def records(batches):
        for batch in batches:
            found = list(zip(*(c.to_pylist() for c in batch.columns)))
            if found:
                yield _batch(found)

    captures = asked.repartition("path").sortWithinPartitions("path", "surt").mapInArrow(places, CAPTURE)
    return captures.repartition("path").sortWithinPartitions("path", "at").mapInArrow(records, RECORD)


def _batch(found: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["surt", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*_records(found)), kinds)], names)


def keys_of(pages: DataFrame, url_col: str) -> DataFrame:
    """The distinct keys of a table of URLs."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], ["surt"])

    return pages.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(run, "surt string").distinct()


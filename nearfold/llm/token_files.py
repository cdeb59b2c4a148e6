"""Token-id files: one zstandard frame per document, a seek table with checksums at the end.

A file is readable by any zstandard decoder. After the document frames come two
skippable frames: the document ids (magic 0x184D2A50), then the seek table of the
zstd seekable format (magic 0x184D2A5E): compressed size, decompressed size and the
low half of the XXH64 of each frame's content, and a footer that gives the number
of frames. A reader takes the footer, the table and the ids, and after that only the
frames of the documents asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from nearfold.llm.chunkcoder import coder
from nearfold.llm.files import attempt_file, in_ranges, place
from nearfold.llm.textbatch import utf8
from nearfold.plans.storage import fresh_dir, written

# Fixed values of the zstd seekable format.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
HEADER = struct.Struct("<II")
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])

NO_ID = -(1 << 63)
LEVEL = 3
READ_BYTES = 4 << 20
DOCUMENTS_AT_ONCE = 256
MANIFEST = "shard int, path string, docs long, tokens long, bytes long"


class FrameWriter:
    """Writes the frames of one file to a stream; ``width`` is 2 or 4 bytes an id."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.table: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.bytes = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        plain = ids.astype(f"<u{self.width}").tobytes()
        packed = self.press.compress(plain)
        self.stream.write(packed)
        self.bytes += len(packed)
        self.tokens += len(ids)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)

    def close(self) -> None:
        names = bytes([self.width]) + self.press.compress(np.array(self.doc_ids, "<i8").tobytes())
        table = np.array(self.table, ENTRY).tobytes() + FOOTER.pack(len(self.table), HAS_CHECKSUMS, SEEKABLE)
        for magic, body in ((SKIPPABLE_IDS, names), (SKIPPABLE_TABLE, table)):
            self.stream.write(HEADER.pack(magic, len(body)) + body)
            self.bytes += HEADER.size + len(body)
        self.stream.close()


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        system, path = place(uri)
        self.file = system.open_input_file(path)
        end = self.file.size()
        frames, flags, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != SEEKABLE or not flags & HAS_CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        at = end - FOOTER.size - frames * ENTRY.itemsize
        self.table = np.frombuffer(self.file.read_at(frames * ENTRY.itemsize, at), ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.table["packed"].astype(np.int64))])
        body = self.file.read_at(at - HEADER.size - int(self.at[-1]), int(self.at[-1]))
        magic, size = HEADER.unpack_from(body)
        if magic != SKIPPABLE_IDS:
            raise ValueError(f"{uri} has no document ids")
        self.width = body[HEADER.size]
        self.unpress = zstandard.ZstdDecompressor()
        names = self.unpress.decompress(body[HEADER.size + 1 : HEADER.size + size], max_output_size=8 * frames)
        self.doc_ids = np.frombuffer(names, "<i8")

    def frames(self, numbers: Iterable[int]) -> Iterator[np.ndarray]:
        """The ids of the frames with these ascending numbers; neighbours are read together."""
        numbers, i = list(numbers), 0
        while i < len(numbers):
            j = i + 1
            while j < len(numbers) and numbers[j] == numbers[j - 1] + 1 and self.at[numbers[j] + 1] - self.at[numbers[i]] <= READ_BYTES:
                j += 1
            first = int(self.at[numbers[i]])
            raw = self.file.read_at(int(self.at[numbers[j - 1] + 1]) - first, first)
            for n in numbers[i:j]:
                packed = raw[int(self.at[n]) - first : int(self.at[n + 1]) - first]
                plain = self.unpress.decompress(packed, max_output_size=int(self.table["plain"][n]))
                if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table["check"][n]:
                    raise ValueError(f"frame {n} does not match its checksum")
                yield np.frombuffer(plain, f"<u{self.width}").astype(np.uint32)
            i = j

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The documents of these ids that the file holds, found by binary search."""
        wanted = np.unique(np.array(list(wanted), np.int64))
        low, high = np.searchsorted(self.doc_ids, wanted), np.searchsorted(self.doc_ids, wanted, "right")
        numbers = [n for a, b in zip(low, high) for n in range(a, b)]
        yield from zip(self.doc_ids[numbers].tolist(), self.frames(numbers))


def write(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int | None = None) -> DataFrame:
    """Encodes every whole text and writes the ids to files in ascending id order; returns the manifest.

    A null text is empty. Rows with a null id come first, rows that repeat an id stay as many, by their text. Other
    columns are ignored; an empty table gives no files. ``end_id`` is appended to each document.
    The manifest (shard, path, docs, tokens, bytes) names only files of successful tasks, in the order of shard.
    """
    folder = fresh_dir(docs.sparkSession, "tokens")

    def run(batches):
        writer, path = None, ""
        shard = TaskContext.get().partitionId()
        encode = coder(vocabulary)
        width = 2 if len(encode.id_bytes) <= 1 << 16 else 4
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, local, path = attempt_file(folder, f"part-{shard:06d}", ".tokens.zst")
                writer = FrameWriter(system.open_output_stream(local, compression=None), width)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode(*utf8(batch.column(1)))):
                writer.add(doc_id, ids if end_id is None else np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": path, "docs": len(writer.doc_ids), "tokens": writer.tokens, "bytes": writer.bytes}],
                pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]),
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from the files alone."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("start"))
    tasks = placed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = FrameReader(path)
                size, crc = [], []
                for ids in reader.frames(range(len(reader.table))):
                    size.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n = np.array(size, np.int64)
                yield pa.record_batch(
                    [
                        pa.array(reader.doc_ids, mask=reader.doc_ids == NO_ID),
                        pa.array(start + np.cumsum(n) - n),
                        pa.array(n),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return tasks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents asked for: each file is opened with the ids in its range, and only their frames are read."""
    files = manifest.select("path", "shard")

    def ranges(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = FrameReader(path).doc_ids
                yield pa.record_batch([pa.array([path]), pa.array(held[:1]), pa.array(held[-1:])], ["path", "first", "last"])

    spans = files.mapInArrow(ranges, "path string, first long, last long")
    wanted = ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    asked = in_ranges(wanted, "doc_id", spans)

    def some(batches):
        name, reader = None, None
        for batch in batches:  # sorted by file and id
            for path in dict.fromkeys(batch.column(0).to_pylist()):
                if path != name:
                    name, reader = path, FrameReader(path)
                mine = batch.filter(pa.compute.equal(batch.column(0), path)).column(1).to_pylist()
                for i in range(0, len(mine), DOCUMENTS_AT_ONCE):
                    found = list(reader.documents(mine[i : i + DOCUMENTS_AT_ONCE]))
                    yield pa.record_batch(
                        [pa.array([d for d, _ in found], pa.int64()), pa.array([x.astype(np.int64) for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"]
                    )

    return asked.repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(some, "doc_id long, ids array<long>")

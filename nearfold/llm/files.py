"""Opening files in shared storage from tasks, by any scheme that pyarrow knows."""

from __future__ import annotations

import bisect
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

FILES_AT_ONCE = 100_000


def place(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def attempt_file(folder: str, stem: str, suffix: str) -> tuple[fs.FileSystem, str, str]:
    """A file name of this attempt's own, so that a task that runs twice never writes one file twice."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    return system, os.path.join(path, name), f"{folder}/{name}"


def _found(keys: DataFrame, column: str, kind: str, paths: list, firsts: list, lasts: list) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast((paths, firsts, lasts))  # FILES_AT_ONCE files at most

    def run(batches) -> Iterator[pa.RecordBatch]:
        paths_, firsts_, lasts_ = held.value
        for batch in batches:
            rows, files = [], []
            for row, key in enumerate(batch.column(0).to_pylist()):
                key = key.encode() if isinstance(key, str) else key
                i = bisect.bisect_left(lasts_, key)
                while i < len(paths_) and firsts_[i] <= key:  # equal keys may go on in the next file
                    rows.append(row)
                    files.append(paths_[i])
                    i += 1
            yield pa.record_batch([pa.array(files, pa.string()), batch.column(0).take(pa.array(rows, pa.int64()))], ["path", column])

    return keys.select(column).mapInArrow(run, f"path string, {column} {kind}")


def in_ranges(keys: DataFrame, column: str, bounds: DataFrame) -> DataFrame:
    """(path, key) for every file whose range first..last holds a key. ``bounds`` has a row per file, whose ranges overlap at their ends only.

    Each task bisects the sorted bounds, so keys meet no file but their own. Bounds are taken in blocks of FILES_AT_ONCE, a pass over
    the keys for each, so what is broadcast does not grow with the files.
    """
    kind, block = keys.schema[column].dataType.simpleString(), ([], [], [])
    found = keys.sparkSession.createDataFrame([], f"path string, {column} {kind}")
    code = lambda x: x.encode() if isinstance(x, str) else x
    for row in bounds.select("path", "first", "last").orderBy("first", "last").toLocalIterator():
        for part, value in zip(block, (row.path, code(row.first), code(row.last))):
            part.append(value)
        if len(block[0]) == FILES_AT_ONCE:
            found, block = found.unionByName(_found(keys, column, kind, *block)), ([], [], [])
    return found.unionByName(_found(keys, column, kind, *block)) if block[0] else found

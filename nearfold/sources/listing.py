"""Files of a mounted folder as a Spark data source: each subtree is listed by a task of its own.

For storage that all executors mount under one path. For stores that only Spark reads, and for contents, see ``files``. Unlike those, this source
knows the times to the nanosecond, the inode and, where the system tells it, the time of creation.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "nearfold_listing"
SCHEMA = "path string, extension string, size long, mtime_ns long, created_at timestamp, modified_at timestamp, inode long"
SPLIT_DEPTH = 2
_UTC = dt.timezone.utc


@dataclass
class Subtree(InputPartition):
    """A folder, with all that is below it or only the files right in it."""

    folder: str
    whole: bool

    @property
    def value(self):
        return self.folder


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return list(found)
    except OSError:  # unreadable, or gone meanwhile
        return []


def extension_of(name: str) -> str | None:
    """In lower case; none for names without a dot and names that only begin or end with one."""
    stem, dot, end = name.rpartition(".")
    return end.lower() if dot and stem and end else None


class ListingReader(DataSourceReader):
    def __init__(self, root: str, depth: int):
        self.root, self.depth, self.wanted = root, depth, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Extensions are asked for before a file is looked at; other filters stay with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("extension",):
                yield f
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self) -> list[Subtree]:
        """The subtrees ``depth`` levels down; only folders above them are opened here."""
        found, level = [], [self.root]
        for _ in range(self.depth):
            found += [Subtree(folder, False) for folder in level]
            level = [e.path for folder in level for e in _entries(folder) if e.is_dir(follow_symlinks=False)]
        return found + [Subtree(folder, True) for folder in level]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        open_ = [partition.folder]
        while open_:
            for e in _entries(open_.pop()):
                try:
                    if e.is_dir(follow_symlinks=False):
                        if partition.whole:
                            open_.append(e.path)
                        continue
                    extension = extension_of(e.name)
                    if not e.is_file(follow_symlinks=False) or (self.wanted is not None and extension not in self.wanted):
                        continue
                    held = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                born = getattr(held, "st_birthtime", None)
                at = lambda seconds: dt.datetime.fromtimestamp(seconds, _UTC)
                yield (f"file:{e.path}", extension, held.st_size, held.st_mtime_ns, at(born) if born is not None else None, at(held.st_mtime_ns // 1000 / 1e6), held.st_ino)


class Listing(DataSource):
    """``spark.read.format("nearfold_listing").option("root", folder)``; ``depth``: so many levels down the subtrees are tasks."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(os.path.abspath(self.options["root"]), int(self.options.get("depth", SPLIT_DEPTH)))


def listed(spark: SparkSession, root: str, session_id: str, extensions=None, depth: int = SPLIT_DEPTH) -> DataFrame:
    """``(session_id, path, size, mtime_ns, created_at, modified_at, inode)`` of the regular files under ``root``, of some lower-case extensions if given.

    Unreadable entries are skipped, links are not followed. Paths are those of ``files.inventory``.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)
    found = spark.read.format(NAME).option("root", root).option("depth", depth).load()
    if extensions is not None:
        found = found.where(F.col("extension").isin(*extensions))
    return found.select(F.lit(session_id).alias("session_id"), "path", "size", "mtime_ns", "created_at", "modified_at", "inode")

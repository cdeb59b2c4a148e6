"""Sources: file listings, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfold.functions.fingerprint import plain_path
from nearfold.functions.scalars import parent_dir


def inventory(spark: SparkSession, root: str, session_id: str, glob: str | None = None) -> DataFrame:
    """``(session_id, path, size, mtime_ns, modified_at)`` of every file under ``root``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(
        F.lit(session_id).alias("session_id"), "path", F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("modificationTime").alias("modified_at"),
    )


def contents(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of every file under ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images with ``path``, ``width`` and ``height``; what does not decode keeps its row with null dimensions."""
    read = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    known, path = F.col("image.width") > 0, plain_path(F.col("image.origin"))
    return read.select(
        "image", path.alias("path"), parent_dir(path).alias("dir"),
        F.when(known, F.col("image.width")).alias("width"), F.when(known, F.col("image.height")).alias("height"),
    )

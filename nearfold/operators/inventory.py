"""Planning a scan: which files are scanned, and which RAW file goes with which image."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from nearfold.functions import scalars as S
from nearfold.plans.schemas import RAW_EXTENSIONS


@dataclass(frozen=True)
class ScanPlan:
    entries: DataFrame
    companions: DataFrame


def inventory_filter(files: DataFrame, include_raw: bool) -> DataFrame:
    """Supported images, with RAW files of all kinds if asked for."""
    path = F.col("path")
    wanted = S.is_supported_image(path)
    return files.where(wanted | S.is_raw_extension(S.extension_lower(path)) if include_raw else wanted & ~S.is_standalone_raw(path))


def companion_pairs(files: DataFrame) -> DataFrame:
    """``(session_id, path, companion_raw_path, companion_raw_size)`` for images with a RAW file beside them.

    Beside: same directory and name but for case and extension. The extension that comes first in RAW_EXTENSIONS wins; of
    names that differ in case only the largest path stands for all; a file is not its own companion. One shuffle
    on (session, directory, stem) serves both sides.
    """
    path = F.col("path")
    keyed = files.select(
        "session_id", "path", "size", S.parent_dir(path).alias("dir"), F.lower(S.file_stem(path)).alias("stem"),
        S.extension_lower(path).alias("ext"),
    ).where("ext is not null")
    rank = F.array_position(F.array(*map(F.lit, RAW_EXTENSIONS)), F.col("ext"))
    raw = keyed.withColumn("rank", rank).where("rank > 0")
    raw = raw.groupBy("session_id", "dir", "stem", "ext").agg(
        F.min("rank").alias("rank"), F.max(F.struct("path", "size")).alias("raw")
    )
    images = keyed.where(S.is_supported_image(path)).select("session_id", "dir", "stem", "path")
    beside = images.join(raw, ["session_id", "dir", "stem"]).where(F.col("path") != F.col("raw.path"))
    best = beside.groupBy("session_id", "path").agg(F.min_by("raw", "rank").alias("raw"))
    return best.select(
        "session_id", "path", F.col("raw.path").alias("companion_raw_path"), F.col("raw.size").alias("companion_raw_size")
    )


def plan_scan(files: DataFrame, include_raw: bool) -> ScanPlan:
    """Scannable images without those that are companions, and the companions by image."""
    found = inventory_filter(files, include_raw)
    scannable = found.where(S.is_supported_image(F.col("path")))
    companions = companion_pairs(found)
    if not include_raw:
        return ScanPlan(scannable, companions.limit(0))
    hidden = companions.select("session_id", F.col("companion_raw_path").alias("path")).distinct()
    return ScanPlan(scannable.join(hidden, ["session_id", "path"], "left_anti"), companions)


def attach_companions(rows: DataFrame, companions: DataFrame) -> DataFrame:
    return rows.drop("companion_raw_path", "companion_raw_size").join(companions, ["session_id", "path"], "left")


def snapshot_diff(inventory: DataFrame, live: DataFrame) -> DataFrame:
    """Each path of either side with its ``change``: new, changed, unchanged or missing.

    Unchanged files have equal size and mtime. ``live`` gives file_id and the old values.
    """
    old = live.select("session_id", "path", "file_id", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime_ns"))
    joined = inventory.select("session_id", "path", "size", "mtime_ns", F.lit(True).alias("here")).join(
        old, ["session_id", "path"], "full_outer"
    )
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime_ns").eqNullSafe(F.col("old_mtime_ns"))
    change = F.when(F.col("file_id").isNull(), "new").when(F.col("here").isNull(), "missing").when(same, "unchanged").otherwise("changed")
    return joined.select("session_id", "path", "file_id", "size", "mtime_ns", "old_size", "old_mtime_ns", change.alias("change"))

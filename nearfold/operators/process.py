"""Fingerprint assembly: one row per file with what the tiers need."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearfold.functions import scalars as S
from nearfold.plans.config import ScanConfig
from nearfold.plans.schemas import EXIF


def assemble(files: DataFrame, config: ScanConfig, contents: DataFrame | None = None, hashes: DataFrame | None = None, exif: DataFrame | None = None):
    """(processed, rejects): ``files`` with content_hash, width, height, dhash, phash and exif.

    A tier that is off leaves its columns null and its input unread. With the visual tier on, a file
    without a fingerprint is a reject as a whole. ``contents``: path, content; ``hashes``: path, width, height, dhash, phash;
    ``exif``: path, exif.
    """
    rows = files.drop("content_hash", "width", "height", "dhash", "phash", "exif")
    if config.exact_hash and contents is not None:
        rows = rows.join(contents.select("path", S.content_hash(F.col("content")).alias("content_hash")), "path", "left")
    else:
        rows = rows.withColumn("content_hash", F.lit(None).cast("string"))
    if hashes is not None:
        keep = ["path", "width", "height", *(["dhash", "phash"] if config.visual_similar else [])]
        rows = rows.join(hashes.select(keep), "path", "left")
    for name, kind in (("width", "int"), ("height", "int"), ("dhash", "long"), ("phash", "long")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    if config.burst_detection and exif is not None:
        rows = rows.join(exif.select("path", "exif"), "path", "left")
    else:
        rows = rows.withColumn("exif", F.lit(None).cast(EXIF))
    if not config.visual_similar:
        return rows, rows.limit(0)
    return rows.where("phash is not null"), rows.where("phash is null")


def exif_from_tags(tags: DataFrame) -> DataFrame:
    """``(path, exif)`` from raw tag values.

    ``tags`` has path, make, model, date_original, date_plain (arrays of strings), iso (array of long), and numerators and
    denominators (arrays of long) of fnumber, exposure and focal.
    """
    ratio = lambda name: S.first_rational(F.col(f"{name}_num"), F.col(f"{name}_den"))
    return tags.select(
        "path",
        F.struct(
            S.exif_date(S.clean_ascii(F.col("date_original")), S.clean_ascii(F.col("date_plain"))).alias("dateTaken"),
            S.clean_ascii(F.col("make")).alias("cameraMake"),
            S.clean_ascii(F.col("model")).alias("cameraModel"),
            F.get("iso", 0).cast("int").alias("iso"),
            S.format_aperture(ratio("fnumber")).alias("aperture"),
            S.format_shutter(ratio("exposure")).alias("shutterSpeed"),
            S.format_focal(ratio("focal")).alias("focalLength"),
        ).alias("exif"),
    )

"""Snapshot tables: upserts, tombstones, loading and writing."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, functions as F

from nearfold.plans.storage import delete, written

KEPT = ("width", "height", "inode", "created_at", "modified_at", "companion_raw_path", "companion_raw_size")


def new_file_id(session_id="session_id", path="path"):
    """A positive 63-bit id from session and path: no counter that would have to pass through one task."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("file"), session_id, path), 1)


def upsert_files(old: DataFrame, new: DataFrame, generation: int) -> DataFrame:
    """``old`` with rows of ``new`` (session_id, path, size, mtime_ns and any of KEPT) put in by (session_id, path).

    A row that exists keeps its file_id, takes all other values (null for those not given) and loses its tombstone.
    """
    given = new.select("session_id", "path", F.struct(*(c for c in new.columns if c not in ("session_id", "path"))).alias("_new"))
    joined = old.join(given, ["session_id", "path"], "full_outer")
    hit = F.col("_new").isNotNull()
    fields = set(given.schema["_new"].dataType.names)
    out = []
    for f in old.schema:
        name = f.name
        if name in ("session_id", "path"):
            column = F.col(name)
        elif name == "file_id":
            column = F.coalesce("file_id", new_file_id())
        elif name == "scan_generation":
            column = F.when(hit, F.lit(generation)).otherwise(F.col(name))
        elif name == "deleted_at":
            column = F.when(~hit, F.col(name))
        elif name in fields:
            column = F.when(hit, F.col(f"_new.{name}")).otherwise(F.col(name))
        elif name in KEPT:
            column = F.when(~hit, F.col(name))
        else:
            column = F.col(name)
        out.append(column.cast(f.dataType).alias(name))
    return joined.select(out)


def upsert_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of the same file_id, nulls included. ``new`` is read twice: give a written table."""
    return old.join(new.select("file_id"), "file_id", "left_anti").unionByName(new, allowMissingColumns=True)


def tombstone_missing(files: DataFrame, inventory: DataFrame, generation: int, now) -> DataFrame:
    """Live files that the inventory does not hold get ``now`` as deleted_at; the others get the new generation."""
    seen = inventory.select("session_id", "path").distinct().withColumn("_seen", F.lit(True))
    joined = files.join(seen, ["session_id", "path"], "left")
    live = F.col("deleted_at").isNull()
    return joined.select(
        *(
            F.when(live & F.col("_seen").isNull(), F.lit(now)).otherwise(F.col(c)).cast(files.schema[c].dataType).alias(c)
            if c == "deleted_at"
            else F.when(live & F.col("_seen"), F.lit(generation)).otherwise(F.col(c)).cast(files.schema[c].dataType).alias(c)
            if c == "scan_generation"
            else F.col(c)
            for c in files.columns
        )
    )


def for_clustering(files: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Live files with their fingerprints; date_taken and camera are taken out of the capture data."""
    sides = [c for c in ("width", "height") if c in files.columns]
    rows = files.where("deleted_at is null").join(fingerprints.drop(*sides), "file_id")
    if "exif" in fingerprints.columns:
        key = F.concat_ws("|", F.coalesce("exif.cameraMake", F.lit("")), F.coalesce("exif.cameraModel", F.lit("")))
        rows = rows.withColumn("date_taken", F.col("exif.dateTaken")).withColumn("camera", F.when(F.col("exif").isNotNull(), key))
    return rows


def write_partitions(df: DataFrame, path: str, sessions=()) -> None:
    """Replaces the sessions that ``df`` holds and leaves the others (dynamic partition overwrite).

    ``sessions`` are replaced even if ``df`` has no row of them: their old rows go. ``df`` is computed once, before anything is replaced, so it may
    read from ``path`` itself.
    """
    df = written(df, "partitions")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)
    wanted = set(sessions)
    if not wanted:
        return
    held = {r.session_id for r in df.where(F.col("session_id").isin(*wanted)).select("session_id").distinct().collect()}
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    for status in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where):
        name, _, value = status.getPath().getName().partition("=")
        if name == "session_id" and unquote(value) in wanted - held:
            delete(spark, status.getPath().toString())


def clear_groups(groups: DataFrame, members: DataFrame, session_id) -> tuple[DataFrame, DataFrame]:
    """(groups, members) without those of a session, as before it is clustered anew."""
    other = ~F.col("session_id").eqNullSafe(F.lit(session_id))
    gone = groups.where(~other).select("group_id")
    return groups.where(other), members.join(gone, "group_id", "left_anti")


def delete_session(tables: dict[str, DataFrame], session_id) -> dict[str, DataFrame]:
    """The tables without a session. Fingerprints go with the files that they belong to. Rows without a session stay."""
    mine = F.col("session_id").eqNullSafe(F.lit(session_id))
    gone = tables["files"].where(mine).select("file_id")
    return {
        name: df.where(~mine) if "session_id" in df.columns else df.join(gone, "file_id", "left_anti")
        for name, df in tables.items()
    }


def create_session(sessions: DataFrame, session_id: str, root: str, config, now, name: str | None = None) -> DataFrame:
    base = root.rstrip("/").rpartition("/")[2]
    row = (session_id, name or base or "Scan", root, "scanning", config.to_json(), 0, now, now)
    return sessions.unionByName(sessions.sparkSession.createDataFrame([row], sessions.schema))


def bump_generation(sessions: DataFrame, session_id: str, now) -> DataFrame:
    mine = F.col("session_id") == session_id
    return sessions.withColumn("scan_generation", F.when(mine, F.col("scan_generation") + 1).otherwise(F.col("scan_generation"))).withColumn(
        "updated_at", F.when(mine, F.lit(now)).otherwise(F.col("updated_at"))
    )


def set_status(sessions: DataFrame, session_id: str, status: str, now) -> DataFrame:
    mine = F.col("session_id") == session_id
    return sessions.withColumn("status", F.when(mine, F.lit(status)).otherwise(F.col("status"))).withColumn(
        "updated_at", F.when(mine, F.lit(now)).otherwise(F.col("updated_at"))
    )


@dataclass(frozen=True)
class Rescan:
    """``files`` after a rescan, the ``fingerprints`` of new and changed ones, and the ``rejects`` that got none."""

    files: DataFrame
    fingerprints: DataFrame
    rejects: DataFrame


def rescan_with_rejects(files: DataFrame, inventory: DataFrame, fingerprint, generation: int, now) -> Rescan:
    """``fingerprint`` is called once, with the new and changed rows of the inventory and their file_id, and its result is written.

    A file that gets no fingerprint is not stored: a new one has no row, of a changed one the old row gets a tombstone (what is stored of it is
    out of date), and the next rescan tries both again. Width and height among the fingerprints go to ``files``.
    """
    from nearfold.operators.inventory import snapshot_diff

    live = files.where("deleted_at is null")
    change = snapshot_diff(inventory, live).where("change in ('new', 'changed')").select("session_id", "path")
    known = files.select("session_id", "path", F.col("file_id").alias("_known"))
    todo = inventory.drop("file_id").join(change, ["session_id", "path"], "left_semi").join(known, ["session_id", "path"], "left")
    todo = written(todo.withColumn("file_id", F.coalesce("_known", new_file_id())).drop("_known"), "todo")
    prints = written(fingerprint(todo), "prints")
    sides = [c for c in ("width", "height") if c in prints.columns and c in files.columns]
    done = todo.drop(*sides).join(prints.select("file_id", *sides), "file_id")
    rejects = todo.join(prints.select("file_id"), "file_id", "left_anti").select("session_id", "path", "size", "mtime_ns")
    seen = inventory.join(rejects.select("session_id", "path"), ["session_id", "path"], "left_anti")
    updated = tombstone_missing(upsert_files(files, done.drop("file_id"), generation), seen, generation, now)
    return Rescan(updated, prints, rejects)


def rescan(files: DataFrame, inventory: DataFrame, fingerprint, generation: int, now) -> tuple[DataFrame, DataFrame]:
    """``rescan_with_rejects`` without the rejects."""
    found = rescan_with_rejects(files, inventory, fingerprint, generation, now)
    return found.files, found.fingerprints

"""Review queries over groups, members, files and fingerprints."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, Window, functions as F

from nearfold.functions.scalars import basename, thumbnail_key
from nearfold.plans.config import ScanConfig
from nearfold.plans.schemas import EXIF
from nearfold.plans.storage import written


class NotFound(LookupError):
    """A session or group that does not exist."""


def groups_of(members: DataFrame) -> DataFrame:
    """One pending group for each cluster of ``cluster`` members."""
    return members.groupBy("group_id").agg(
        F.first("session_id").alias("session_id"), F.first("kind").alias("kind"), F.first("confidence").alias("confidence"),
        F.lit("pending").alias("review_status"),
    )


def member_rows(members: DataFrame) -> DataFrame:
    """The member table: every (group, file) once, undecided."""
    return members.select("group_id", "session_id", "file_id").dropDuplicates(["group_id", "file_id"]).withColumn("is_keeper", F.lit(None).cast("boolean"))


def recoverable_bytes(members: DataFrame, files: DataFrame) -> DataFrame:
    """``(group_id, member_count, bytes_recoverable)``; members that are no keepers count with their companions."""
    size = F.col("size") + F.coalesce("companion_raw_size", F.lit(0))
    loose = ~F.coalesce("is_keeper", F.lit(False))
    sized = members.join(files.select("file_id", "size", "companion_raw_size"), "file_id", "left")
    return sized.groupBy("group_id").agg(
        F.count("*").alias("member_count"), F.greatest(F.coalesce(F.sum(F.when(loose, size)), F.lit(0)), F.lit(0)).alias("bytes_recoverable")
    )


def list_sessions(sessions: DataFrame, files: DataFrame, groups: DataFrame) -> DataFrame:
    """Sessions, the latest first, with their counts of live files, pending groups and groups."""
    live = files.groupBy("session_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("file_count"))
    counts = groups.groupBy("session_id").agg(
        F.count_if(F.col("review_status") == "pending").alias("pending_groups"), F.count("*").alias("total_groups")
    )
    joined = sessions.join(live, "session_id", "left").join(counts, "session_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("file_count", "pending_groups", "total_groups")}
    return joined.withColumns(zero).orderBy(F.desc("updated_at"), "session_id")


def list_groups(
    groups: DataFrame, members: DataFrame, files: DataFrame, session_id=None, status: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """A page of groups, the most certain first, with member counts and recoverable bytes."""
    wanted = groups if session_id is None else groups.where(F.col("session_id") == session_id)
    wanted = wanted if status is None else wanted.where(F.col("review_status") == status)
    order = (F.desc("confidence"), F.asc("group_id"))
    page = written(wanted.orderBy(*order).offset(offset).limit(limit), "page")  # cut first: only the members of its groups are summed
    totals = recoverable_bytes(members.join(page.select("group_id"), "group_id", "left_semi"), files)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("member_count", "bytes_recoverable")}
    return page.join(totals, "group_id", "left").withColumns(zero).orderBy(*order)


def group_details(groups: DataFrame, members: DataFrame, files: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Every group with its live members, the largest first, and its recoverable bytes."""
    exif = F.col("exif") if "exif" in fingerprints.columns else F.lit(None).cast(EXIF)
    prints = fingerprints.select("file_id", exif.alias("exif"))
    for name in ("created_at", "modified_at"):
        files = files if name in files.columns else files.withColumn(name, F.lit(None).cast("timestamp"))
    path = F.col("path")
    rows = (
        members.join(files.where("deleted_at is null").drop("session_id"), "file_id")
        .join(prints, "file_id", "left")
        .withColumn(
            "m",
            F.struct(
                (-F.col("size")).alias("order"), "file_id", "path", basename(path).alias("file_name"), "size", "width", "height", "created_at",
                "modified_at", thumbnail_key(path, F.col("size")).alias("thumbnail_key"), "is_keeper", "exif", "companion_raw_path", "companion_raw_size",
            ),
        )
    )
    nested = rows.groupBy("group_id").agg(F.array_sort(F.collect_list("m")).alias("members"))
    totals = recoverable_bytes(members, files).select("group_id", "bytes_recoverable")
    return (
        groups.join(nested, "group_id", "left")
        .join(totals, "group_id", "left")
        .withColumn("members", F.transform("members", lambda m: m.dropFields("order")))
        .withColumn("bytes_recoverable", F.coalesce("bytes_recoverable", F.lit(0)))
    )


def group_detail(groups: DataFrame, members: DataFrame, files: DataFrame, fingerprints: DataFrame, group_id: int) -> DataFrame:
    """The one group, or NotFound."""
    one = groups.where(F.col("group_id") == group_id)
    if one.isEmpty():
        raise NotFound(f"group {group_id}")
    return group_details(one, members.where(F.col("group_id") == group_id), files, fingerprints)


def count_groups(groups: DataFrame) -> DataFrame:
    return groups.groupBy("session_id").agg(F.count("*").alias("groups"))


def session_config(sessions: DataFrame, session_id: str):
    """(root_path, config text) of a session, or NotFound."""
    row = sessions.where(F.col("session_id") == session_id).select("root_path", "config").first()
    if row is None:
        raise NotFound(f"session {session_id}")
    return row.root_path, row.config


def session_configs(sessions: DataFrame) -> DataFrame:
    """``(session_id, root_path)`` and a column for each setting: that of the stored text, or the default where it is missing, null or malformed."""
    defaults = asdict(ScanConfig())
    kinds = {bool: "boolean", int: "int"}
    names = json.loads(ScanConfig().to_json()).keys()
    held = F.from_json("config", ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, defaults.values())))
    return sessions.withColumn("_c", held).select("session_id", "root_path", *(F.coalesce(F.col("_c")[n], F.lit(v)).alias(c) for n, (c, v) in zip(names, defaults.items())))


def progress(metrics: DataFrame, groups: DataFrame, session_id: str) -> DataFrame:
    """The progress row of a session with its number of groups, or NotFound."""
    one = metrics.where(F.col("session_id") == session_id)
    if one.isEmpty():
        raise NotFound(f"progress of session {session_id}")
    return one.join(count_groups(groups), "session_id", "left").withColumn("groups", F.coalesce("groups", F.lit(0)))


def suggested_keepers(members: DataFrame, files: DataFrame) -> DataFrame:
    """``(group_id, file_id)``: the largest area, then the earliest date, then the largest size, then the smallest id."""
    area = F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0)).cast("long")
    taken = F.unix_micros(F.col("date_taken").cast("timestamp"))
    order = F.struct((-area).alias("area"), F.coalesce(taken, F.lit((1 << 63) - 1)).alias("taken"), (-F.col("size")).alias("size"), "file_id")
    rows = members.select("group_id", "file_id").join(files.select("file_id", "width", "height", "date_taken", "size"), "file_id")
    return rows.groupBy("group_id").agg(F.min_by("file_id", order).alias("file_id"))


def next_groups(groups: DataFrame) -> DataFrame:
    """For each pending group of a session the next in the order of the queue; the first after the last.

    The queue is cut into ranges of its order, also within a session. What follows the last group of a range comes from a table with a row for
    each range and session, so no task holds a whole session.
    """
    order = (F.desc("confidence"), F.asc("group_id"))
    queue = groups.where("review_status = 'pending'").select("session_id", "group_id", "confidence")
    queue = written(queue.repartitionByRange("session_id", *order).withColumn("part", F.spark_partition_id()), "queue")
    by = Window.partitionBy("session_id", "part").orderBy(*order)
    rows = written(queue.withColumns({"n": F.row_number().over(by), "ahead": F.lead("group_id").over(by)}), "ahead")
    parts = Window.partitionBy("session_id").orderBy("part")  # a row per range
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = rows.where("n = 1").select("session_id", "part", "group_id")
    edges = edges.withColumn("after", F.coalesce(F.lead("group_id").over(parts), F.first("group_id").over(whole))).drop("group_id")
    edges = written(edges, "edges").withColumnsRenamed({"session_id": "_session", "part": "_part"})
    joined = rows.join(edges, rows["session_id"].eqNullSafe(F.col("_session")) & (rows["part"] == F.col("_part")))
    return joined.select("session_id", "group_id", F.coalesce("ahead", "after").alias("next_group_id"))

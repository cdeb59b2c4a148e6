"""Keeper decisions, undo and the purge.

Decisions come as arrays of keepers by group (``apply_keepers``), or as a log of events with a row for each keeper (``replayed``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from nearfold.plans.storage import written


class NoKeeper(ValueError):
    """A purge of a group in which nothing is kept."""


def latest_decisions(log: DataFrame) -> DataFrame:
    """``(group_id, keepers)``: the latest decision of each group that was not undone.

    ``log`` has group_id, seq, keepers (array of file_id) and undone.
    """
    by = Window.partitionBy("group_id").orderBy(F.desc("seq"))  # the decisions on one group
    return log.where(~F.coalesce("undone", F.lit(False))).withColumn("n", F.row_number().over(by)).where("n = 1").select("group_id", "keepers")


KEEP, KEEP_ALL, UNDO = "keep", "keep_all", "undo"


def with_undone(events: DataFrame) -> DataFrame:
    """The keep and keep_all events of a log, each with ``undone``.

    ``events`` (session_id, seq, op, group_id) is append-only: "keep" and "keep_all" act on a group and go on the stack of their session, "undo" takes the last
    one off and has no group; with an empty stack it does nothing. The height of the stack is a running sum that does not fall below
    zero. At each height events and undos take turns, so an event is undone if an undo follows it there.
    """
    by = Window.partitionBy("session_id").orderBy("seq")  # the decisions of one person at a time
    step = F.when(F.col("op") == UNDO, -1).otherwise(1)
    rows = events.withColumn("step", step).withColumn("sum", F.sum("step").over(by))
    rows = rows.withColumn("floor", F.least(F.lit(0), F.min("sum").over(by)))
    before = F.coalesce(F.lag("floor").over(by), F.lit(0))
    rows = rows.withColumn("idle", (F.col("op") == UNDO) & (F.col("sum") < before)).where("not idle")
    rows = rows.withColumn("height", F.col("sum") - F.col("floor") + F.when(F.col("op") == UNDO, 1).otherwise(0))
    at = Window.partitionBy("session_id", "height").orderBy("seq")
    rows = rows.withColumn("undone", F.coalesce(F.lead("op").over(at) == UNDO, F.lit(False)))
    return rows.where(F.col("op") != UNDO).select("session_id", "seq", "op", "group_id", "undone")


def replayed(groups: DataFrame, members: DataFrame, events: DataFrame, keepers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members) after a log of decisions; ``keepers`` has a row (session_id, seq, file_id) for each file that a keep event keeps.

    An undo brings back the keepers that the group had before the event: those of its last event that is not undone. If there is none, they are those that
    ``members`` has, and the others are no keepers, as after any decision. Groups without an event stay as they are. A group that was once kept as a
    whole stays resolved. Events of other groups or sessions than those given are ignored.
    """
    told = written(with_undone(events), "told")
    last = told.groupBy("group_id").agg(
        F.max(F.when(~F.col("undone"), F.struct("seq", "op", "session_id"))).alias("open"), F.bool_or(F.col("op") == KEEP_ALL).alias("whole")
    )
    last = written(last.select("group_id", "open.seq", "open.op", F.col("open.session_id").alias("by"), "whole"), "last")  # written: a hot group can be split
    listed = keepers.select(F.col("session_id").alias("by"), "seq", "file_id", F.lit(True).alias("listed")).distinct()
    joined = members.join(last, "group_id", "left").join(listed, ["by", "seq", "file_id"], "left")
    kept = (
        F.when(F.col("op") == KEEP_ALL, True).when(F.col("op") == KEEP, F.coalesce("listed", F.lit(False)))
        .when(F.col("whole").isNotNull(), F.coalesce("is_keeper", F.lit(False))).otherwise(F.col("is_keeper"))
    )
    done = groups.join(last.select("group_id", "whole"), "group_id", "left")
    done = done.withColumn("review_status", F.when(F.col("whole"), "resolved").otherwise(F.col("review_status")))
    return done.select(groups.columns), joined.withColumn("is_keeper", kept).select(members.columns)


def apply_keepers(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Listed files are keepers, the others of their group are not; groups without a decision stay as they are."""
    joined = members.join(decisions.select("group_id", "keepers"), "group_id", "left")
    told = F.when(F.col("keepers").isNotNull(), F.array_contains("keepers", F.col("file_id"))).otherwise(F.col("is_keeper"))
    return joined.withColumn("is_keeper", told).drop("keepers")


def keep_all(groups: DataFrame, members: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members) with every member of the chosen groups a keeper and those groups resolved."""
    mark = chosen.select("group_id").distinct().withColumn("chosen", F.lit(True))
    groups = groups.join(mark, "group_id", "left").withColumn("review_status", F.when(F.col("chosen"), "resolved").otherwise(F.col("review_status"))).drop("chosen")
    members = members.join(mark, "group_id", "left").withColumn("is_keeper", F.when(F.col("chosen"), True).otherwise(F.col("is_keeper"))).drop("chosen")
    return groups, members


def purge_manifest(members: DataFrame, files: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """``(group_id, file_id, role, path, bytes)`` of what to delete: live members that are no keepers, of groups with a live keeper, and their companions.

    A keeper that is deleted keeps nothing: a group of which no live member is kept loses nothing. Groups given as ``chosen`` of which
    none is kept raise NoKeeper.
    """
    alive = members.select("group_id", "file_id", F.coalesce("is_keeper", F.lit(False)).alias("is_keeper")).join(files.where("deleted_at is null").drop("session_id", "group_id", "is_keeper"), "file_id")
    kept = written(alive.where("is_keeper").select("group_id").distinct(), "kept")
    if chosen is not None:
        bad = chosen.select("group_id").distinct().join(kept, "group_id", "left_anti").limit(5).collect()
        if bad:
            raise NoKeeper(f"no live keeper in groups {sorted(r.group_id for r in bad)}")
    rows = alive.where("not is_keeper").join(kept, "group_id", "left_semi")
    parts = F.array(
        F.struct(F.lit("primary").alias("role"), F.col("path").alias("path"), F.col("size").alias("bytes")),
        F.struct(F.lit("companion").alias("role"), F.col("companion_raw_path").alias("path"), F.coalesce("companion_raw_size", F.lit(0)).alias("bytes")),
    )
    return rows.select("group_id", "file_id", F.explode(parts).alias("p")).select("group_id", "file_id", "p.*").where("path is not null")


def keep_selected_and_purge(members: DataFrame, files: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, manifest): the chosen files (group_id, keepers) are kept and what their groups then lose is listed.

    A chosen group of which no live member is kept raises NoKeeper.
    """
    kept = apply_keepers(members, chosen)
    return kept, purge_manifest(kept, files, chosen)


@dataclass(frozen=True)
class Purged:
    files: DataFrame
    groups: DataFrame
    result: DataFrame


def _effective(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The manifest with ``error`` (null: deleted); a companion is tried only if its primary is gone."""
    told = manifest.join(outcomes.select("path", F.coalesce("error", F.when(~F.col("ok"), F.lit("failed"))).alias("error"), F.lit(True).alias("tried")), "path", "left")
    told = told.withColumn("error", F.when(F.col("tried").isNull(), F.lit("not tried")).otherwise(F.col("error")))
    gone = told.where("role = 'primary' and error is null").select("group_id", "file_id")
    return told.where("role = 'primary'").unionByName(told.where("role = 'companion'").join(gone, ["group_id", "file_id"], "left_semi"))


def purge_result(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(group_id, trashed_count, bytes_freed, errors)``; ``outcomes`` has path, ok and error of the job that deleted."""
    done = F.col("error").isNull()
    return _effective(manifest, outcomes).groupBy("group_id").agg(
        F.count_if(done).alias("trashed_count"),
        F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).alias("bytes_freed"),
        F.array_sort(F.collect_list(F.when(~done, F.concat_ws(": ", "path", "error")))).alias("errors"),
    )


def apply_purge(files: DataFrame, groups: DataFrame, manifest: DataFrame, outcomes: DataFrame, now) -> Purged:
    """Files that are gone get ``now`` as deleted_at; groups of which anything is gone are resolved."""
    gone = _effective(manifest, outcomes).where("error is null and role = 'primary'").select("file_id").distinct().withColumn("gone", F.lit(True))
    result = purge_result(manifest, outcomes)
    done = result.where("trashed_count > 0").select("group_id", F.lit(True).alias("done"))
    return Purged(
        files.join(gone, "file_id", "left").withColumn("deleted_at", F.when(F.col("gone"), F.lit(now)).otherwise(F.col("deleted_at"))).drop("gone"),
        groups.join(done, "group_id", "left").withColumn("review_status", F.when(F.col("done"), "resolved").otherwise(F.col("review_status"))).drop("done"),
        result,
    )

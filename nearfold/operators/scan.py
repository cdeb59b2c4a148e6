"""A whole scan of one session: plan, difference, fingerprints, upsert, tombstones, groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from nearfold.operators import cluster, inventory, review
from nearfold.plans.config import ScanConfig
from nearfold.plans.storage import written
from nearfold.sources import snapshot


@dataclass(frozen=True)
class Tables:
    """The stored tables: sessions, files, fingerprints, groups and members, as in ``plans.schemas``."""

    sessions: DataFrame
    files: DataFrame
    fingerprints: DataFrame
    groups: DataFrame
    members: DataFrame


@dataclass(frozen=True)
class Scanned(Tables):
    """The tables after a scan, and the ``rejects`` (session_id, path, size, mtime_ns) that got no fingerprint."""

    rejects: DataFrame


def scan(
    tables: Tables, listing: DataFrame, session_id: str, config: ScanConfig, fingerprint: Callable[[DataFrame], DataFrame], now,
    burst_window_secs: int | None = None, band_count: int | None = 1,
) -> Scanned:
    """The tables after a scan of a session.

    ``listing`` has session_id, path, size and mtime_ns of every file there is. Only new and changed files are given to
    ``fingerprint``, once, which returns file_id and the columns of the fingerprints, with width and height if it knows them; files that are gone
    get ``now`` as deleted_at. Files without a fingerprint are rejects: not stored, and tried again by the next scan.
    The session's groups are made anew from its live files, those of other sessions stay; its status becomes "reviewing".
    ``band_count`` is that of the visual tier: one band, so prints are linked that have their top 16 bits in common; None for every link within the threshold.
    """
    mine = F.col("session_id").eqNullSafe(F.lit(session_id))
    sessions = snapshot.bump_generation(tables.sessions, session_id, now)
    generation = sessions.where(mine).select("scan_generation").first()[0]
    plan = inventory.plan_scan(listing.where(mine), config.include_raw)
    wanted = inventory.attach_companions(plan.entries, plan.companions)
    own, others = tables.files.where(mine), tables.files.where(~mine)
    found = snapshot.rescan_with_rejects(own, wanted, fingerprint, generation, now)
    updated = written(found.files, "files")
    stored = [c for c in found.fingerprints.columns if c in tables.fingerprints.columns]
    prints = written(snapshot.upsert_fingerprints(tables.fingerprints, found.fingerprints.select(stored)), "fingerprints")
    live = snapshot.for_clustering(updated, prints)
    grouped = written(cluster.tiered_members(live, config, burst_window_secs, band_count=band_count), "members")
    groups, members = snapshot.clear_groups(tables.groups, tables.members, session_id)
    return Scanned(
        snapshot.set_status(sessions, session_id, "reviewing", now),
        others.unionByName(updated),
        prints,
        groups.unionByName(review.groups_of(grouped).select(groups.columns)),
        members.unionByName(review.member_rows(grouped).select(members.columns)),
        found.rejects,
    )

"""Clusters kept up to date: a delta of files changes the groups that it touches, and no others.

The state is what the three tiers know of the live files: exact members by content hash; nodes (rows equal in fingerprint, size and
dimensions stand as one, named by a digest of those values, so that a node outlives its files) and the
component of each node; burst rows with their islands (stretches without a gap over the window). ``apply`` takes inserted or changed files and
deleted ids and goes down the tiers:

* exact: the hashes of the delta, old and new, are grouped anew; other hashes keep their groups.
* visual: files enter or leave when they themselves change or their hash begins or ceases to be a group. New nodes are linked within the
  blocks that hold them; nodes without files go. Only components that lose a node are split again. What is left of these and the new nodes are linked
  with one another and with the other nodes, which stand for their components as wholes. Members and confidences of touched components are computed anew.
* burst: islands that lose a row, or have a new row within the window, are folded anew from their rows. No anchor outside depends on them.

No pair of nodes is stored: the links of all pairs grow with the square of a dense group. Those of ``cluster.component_links``, which join the same
nodes, are made anew where an end is a new node or of a broken component. Every link within the threshold counts.

Old tables meet the delta by semi and anti joins on touched keys. Spark broadcasts those keys while they are few (a size it checks) and shuffles by them
beyond that. The result is the same as that of ``cluster.tiered_members`` over all live files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfold.operators import cluster
from nearfold.operators.components import connected_components
from nearfold.plans.storage import scratch, written

FILE = ["session_id", "file_id", "content_hash", "phash", "size", "width", "height", "date_taken", "camera"]
VALUES = ["session_id", "phash", "size", "width", "height"]


@dataclass(frozen=True)
class State:
    """The stored tables of clusters that are kept up to date."""

    files: DataFrame  #: live files, FILE
    exact: DataFrame  #: session_id, content_hash, group_id, file_id
    seen: DataFrame  #: node, file_id: the files of the visual tier
    nodes: DataFrame  #: id, VALUES, n (files)
    parts: DataFrame  #: id, component
    visual: DataFrame  #: component, group_id, confidence, session_id, file_id
    timeline: DataFrame  #: session_id, file_id, us, camera, island
    bursts: DataFrame  #: session_id, island, group_id, file_id

    def members(self) -> DataFrame:
        """The members of all groups, as ``cluster.tiered_members`` gives them."""
        kind = lambda df, name, confidence: df.select(
            "session_id", F.lit(name).alias("kind"), confidence.cast("float").alias("confidence"), "group_id", "file_id"
        )
        found = kind(self.exact, "exact", F.lit(1.0)).unionByName(kind(self.visual, "visual", F.col("confidence")))
        return found.unionByName(kind(self.bursts, "burst", F.lit(cluster.BURST_CONFIDENCE)))


def empty(spark: SparkSession, session_type: str = "string") -> State:
    """The state without files."""
    session = f"session_id {session_type}"
    values = f"{session}, phash long, size long, width int, height int"
    schemas = (
        f"{session}, file_id long, content_hash string, phash long, size long, width int, height int, date_taken timestamp, camera string",
        f"{session}, content_hash string, group_id long, file_id long", "node string, file_id long", f"id string, {values}, n long",
        "id string, component string",
        f"component string, group_id long, confidence float, {session}, file_id long", f"{session}, file_id long, us long, camera string, island long",
        f"{session}, island long, group_id long, file_id long",
    )
    return State(*(spark.createDataFrame([], s) for s in schemas))


def _only(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def _but(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def _changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gone, come): rows of one side only; of a changed row both versions."""
    new = new.select(old.columns)
    return old.exceptAll(new), new.exceptAll(old)


def apply(state: State, upserts: DataFrame, deletes: DataFrame, threshold: int = 6, window_secs: int = 2, camera: str = "camera") -> State:
    """The state after a delta: ``upserts`` (FILE) come in or replace the rows of their file_id, ``deletes`` (file_id) go.

    A file_id in both goes. Files without a session take no part in groups. File ids must be unique within ``upserts``; those that are not known may be deleted.
    """
    spark = state.files.sparkSession
    with scratch(spark) as keep:
        deletes = written(deletes.select("file_id").distinct(), "deletes")
        given = upserts.where("session_id is not null").withColumn("camera", F.col(camera)).select(FILE)
        coming = written(_but(given, deletes, "file_id"), "coming")
        ids = written(coming.select("file_id").unionByName(deletes).distinct(), "ids")
        before = written(_only(state.files, ids, "file_id"), "before")
        files = keep(_but(state.files, ids, "file_id").unionByName(coming), "files")

        # exact
        hashes = before.unionByName(coming).where("content_hash is not null").select("session_id", "content_hash").distinct()
        same = written(_only(files, hashes, "session_id", "content_hash"), "same")
        old_exact = written(_only(state.exact, hashes, "session_id", "content_hash"), "old-exact")
        groups = cluster.exact_members(same).join(same.select("file_id", "content_hash"), "file_id").select(state.exact.columns)
        new_exact = written(groups, "new-exact")
        exact = keep(_but(state.exact, hashes, "session_id", "content_hash").unionByName(new_exact), "exact")
        # whoever may have come into the later tiers or left them
        doubtful = written(ids.unionByName(old_exact.select("file_id")).unionByName(new_exact.select("file_id")).distinct(), "doubtful")
        was = written(_but(_only(state.files, doubtful, "file_id"), old_exact, "file_id"), "was")
        now = written(_but(_only(files, doubtful, "file_id"), new_exact, "file_id"), "now")

        # visual: files, nodes
        print_ = lambda df: df.where("phash is not null").withColumn("node", cluster.set_name())
        gone, come = _changes(print_(was).select("node", "file_id"), print_(now).select("node", "file_id"))
        gone, come = written(gone, "gone"), written(come, "come")
        seen = keep(state.seen.join(gone, ["node", "file_id"], "left_anti").unionByName(come), "seen")
        moved = gone.select("node", F.lit(-1).alias("by")).unionByName(come.select("node", F.lit(1).alias("by")))
        moved = written(moved.groupBy(F.col("node").alias("id")).agg(F.sum("by").alias("by"), F.count("*").alias("touched")), "moved")
        had = written(_only(state.nodes, moved, "id"), "had")
        counted = had.unionByName(_values(_but(print_(now), had.select(F.col("id").alias("node")), "node")))
        counted = counted.join(moved, "id").withColumn("n", F.col("n") + F.col("by")).select(state.nodes.columns)
        counted = written(counted, "counted")
        alive = counted.where("n > 0")
        nodes = keep(_but(state.nodes, moved, "id").unionByName(alive), "nodes")
        dead, fresh = counted.where("n = 0").select("id"), written(_but(alive, had, "id"), "fresh")
        # asked: fresh nodes and what is left of the components that lost a node. The others keep their components, which links of asked nodes may join
        broken = _only(state.parts, dead, "id").select("component").distinct()
        pieces = written(_but(_only(state.parts, broken, "component"), dead, "id").select("id"), "pieces")
        alone = fresh.select("id").unionByName(pieces).select("id", F.col("id").alias("component"), F.lit(True).alias("asked"))
        rough = written(_but(state.parts, broken, "component").withColumn("asked", F.lit(False)).unionByName(alone), "rough")
        # components meet as wholes, by number: the links of a dense one are between few numbers
        names = written(rough.select("component").distinct().withColumn("number", F.monotonically_increasing_id()), "names")
        numbered = rough.join(names, "component").select("id", "number", "asked").join(nodes.drop("n"), "id")
        numbered = written(numbered.select(F.col("number").alias("id"), *VALUES, "asked"), "numbered")
        links = cluster.component_links(numbered, threshold, cluster.all_bands(threshold))
        joined = connected_components(links, "a_id", "b_id").select(F.col("node").alias("number"), F.col("component").alias("first"))
        whole = names.select(F.col("number").alias("first"), F.col("component").alias("whole"))
        joined = written(names.join(joined, "number").join(whole, "first").select("component", "whole"), "joined")
        parts = rough.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
        parts = keep(parts, "parts")
        # groups of touched components
        touched = moved.select("id").unionByName(pieces).unionByName(_only(rough, joined, "component").select("id"))
        touched = written(touched.distinct(), "touched")
        dropped = written(_only(state.parts, touched, "id").select("component").distinct(), "dropped")
        again = written(_only(parts, _only(parts, touched, "id").select("component").distinct(), "component"), "again")
        rows = again.select(F.col("component").alias("group_id"), "id").join(nodes.select("id", "phash", "n"), "id")
        sure = cluster.group_confidences(rows.select("group_id", "phash", "n"), threshold)
        sure = written(sure.withColumnRenamed("group_id", "component"), "confidences")
        held = again.join(sure, "component").join(seen.withColumnRenamed("node", "id"), "id").select("component", "confidence", "file_id")
        held = written(held, "held")
        least = written(held.groupBy("component").agg(F.min("file_id").alias("group_id")), "least")
        new_visual = held.join(least, "component").join(files.select("file_id", "session_id"), "file_id").select(state.visual.columns)
        new_visual = written(new_visual, "new-visual")
        old_visual = written(_only(state.visual, dropped, "component"), "old-visual")
        visual = keep(_but(state.visual, dropped, "component").unionByName(new_visual), "visual")

        # burst
        doubtful = written(doubtful.unionByName(old_visual.select("file_id")).unionByName(new_visual.select("file_id")).distinct(), "doubtful-too")
        on_line = written(_only(state.timeline, doubtful, "file_id"), "on-line")
        late = _but(_but(_only(files, doubtful, "file_id"), exact, "file_id"), visual, "file_id")
        window_us = window_secs * 1_000_000
        gone, come = _changes(on_line.drop("island"), cluster.dated_rows(late))
        gone, come = written(gone, "left-line"), written(come, "new-line")
        lost = on_line.join(gone.select("file_id"), "file_id", "left_semi").select("session_id", "island")
        hit = written(lost.unionByName(_near(state.timeline, come, window_us)).distinct(), "islands")
        stretch = _but(_only(state.timeline, hit, "session_id", "island").drop("island"), gone, "file_id").unionByName(come)
        stretch = written(stretch, "stretch")
        placed = written(cluster._islands(stretch, window_us), "placed")
        timeline = keep(_but(state.timeline, hit, "session_id", "island").unionByName(placed.select(state.timeline.columns)), "timeline")
        new_bursts = cluster.burst_rows(stretch, window_us).join(placed.select("file_id", "island"), "file_id").select(state.bursts.columns)
        bursts = keep(_but(state.bursts, hit, "session_id", "island").unionByName(new_bursts), "bursts")
    return State(files, exact, seen, nodes, parts, visual, timeline, bursts)


def _values(rows: DataFrame) -> DataFrame:
    """The nodes of ``rows`` with no file counted yet."""
    return rows.select(F.col("node").alias("id"), *VALUES).distinct().withColumn("n", F.lit(0).cast("long"))


def _near(timeline: DataFrame, come: DataFrame, window_us: int) -> DataFrame:
    """The islands that have a row within the window of a new one, from the rows of the days around the new ones."""
    day = lambda us: F.floor(us / F.lit(86_400_000_000))
    days = lambda low, high: F.explode(F.sequence(day(low), day(high)))
    asked = come.select("session_id", "us").distinct()
    around = asked.select("session_id", days(F.col("us") - window_us, F.col("us") + window_us).alias("day")).distinct()
    rows = timeline.withColumn("day", day(F.col("us"))).join(around, ["session_id", "day"], "left_semi")
    spans = rows.groupBy("session_id", "island", "day").agg((F.min("us") - window_us).alias("low"), (F.max("us") + window_us).alias("high"))
    spans = spans.drop("day").withColumn("day", days(F.col("low"), F.col("high")))  # an island has no gap over the window between its rows of a day
    return asked.withColumn("day", day(F.col("us"))).join(spans, ["session_id", "day"]).where("us between low and high").select("session_id", "island")

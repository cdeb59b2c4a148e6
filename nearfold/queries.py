"""The registered queries over the given tables, and their SQL.

The tables are projected into the data model: documents with events of the same number are photos (language for
session, event time and type for capture time and camera), document numbers spell an inventory of
paths, events are shots, embeddings are 8 x 8 rasters. Decisions keep the suggested keeper of groups whose number is
0 modulo 3, everything where it is 1 and nothing yet where it is 2.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfold.functions import fingerprint as P, scalars as S
from nearfold.operators import cluster, decisions, incremental, inventory, process, review, scan as scans
from nearfold.plans import schemas
from nearfold.plans.config import PRESETS, ScanConfig
from nearfold.plans.storage import fresh_dir, written
from nearfold.sources import snapshot
from nearfold.streaming import ingest as streaming, metrics, upsert

THRESHOLD = 6
PHOTO_WINDOW = 600
SHOT_WINDOW = 600
FEED_WINDOW = 6_000
SHOT_SESSIONS = 20
NOW = dt.datetime(2024, 6, 1)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str, prints: bool = True) -> DataFrame:
    docs, events = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "events")
    shot = events.select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("date_taken"), F.col("event_type").alias("camera_make"))
    unknown = F.col("doc_id") % 11 == 0
    rows = docs.join(shot, "doc_id", "left").select(
        F.col("doc_id").alias("file_id"),
        F.col("lang").alias("session_id"),
        F.col("n_chars").alias("size"),
        F.when(~unknown, 100 * F.length(F.col("n_chars").cast("string"))).alias("width"),
        F.when(~unknown, (100 * (1 + F.col("doc_id") % 3)).cast("int")).alias("height"),
        S.content_hash(F.col("text")).alias("content_hash"),
        "date_taken",
        S.camera_key(F.col("camera_make"), F.lit(None).cast("string")).alias("camera"),
        F.concat(F.lit("/lib/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/lib/"), F.col("doc_id").cast("string"), F.lit(".ARW"))).alias("companion_raw_path"),
        F.when(F.col("doc_id") % 5 == 0, 2 * F.col("n_chars")).alias("companion_raw_size"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(NOW)).alias("deleted_at"),
    )
    if prints:
        found = P.text_fingerprints(docs, "doc_id", "text").withColumnRenamed("doc_id", "file_id")
        rows = rows.join(found, "file_id", "left")
    return rows


def _groups(spark: SparkSession, sf_dir: str):
    """(files, groups, members) of the exact tier."""
    files = photos(spark, sf_dir, prints=False)
    members = written(cluster.exact_members(files), "exact")
    return files, review.groups_of(members), review.member_rows(members)


def _decided(spark: SparkSession, sf_dir: str):
    """(files, groups, members, log): members after the latest decisions of the log."""
    files, groups, members = _groups(spark, sf_dir)
    keeper = review.suggested_keepers(members, files)
    all_ids = members.groupBy("group_id").agg(F.array_sort(F.collect_list("file_id")).alias("ids"))
    one = keeper.join(all_ids, "group_id").where("group_id % 3 <> 2").select(
        "group_id", F.lit(1).alias("seq"), F.when(F.col("group_id") % 3 == 0, F.array("file_id")).otherwise(F.col("ids")).alias("keepers"), F.lit(False).alias("undone")
    )
    # a second decision keeps the last file; it is undone where the group is even
    two = all_ids.where("group_id % 3 = 0").select("group_id", F.lit(2).alias("seq"), F.slice("ids", -1, 1).alias("keepers"), (F.col("group_id") % 2 == 0).alias("undone"))
    log = one.unionByName(two)
    return files, groups, written(decisions.apply_keepers(members, decisions.latest_decisions(log)), "decided"), log


def exact_groups(spark, sf_dir):
    files, groups, members = _groups(spark, sf_dir)
    totals = review.recoverable_bytes(members, files)
    return groups.join(totals, "group_id").select("session_id", "group_id", "member_count", "bytes_recoverable").orderBy("session_id", "group_id")


def exact_members(spark, sf_dir):
    return cluster.exact_members(photos(spark, sf_dir, prints=False)).select("session_id", "group_id", "file_id")


def text_fingerprints(spark, sf_dir):
    found = P.text_fingerprints(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lpad(F.lower(F.hex("phash")), 16, "0").alias("phash"))


def _left(spark, sf_dir):
    files = written(photos(spark, sf_dir), "photos")
    return cluster.without(files, cluster.exact_members(files))


def simhash_prefix_pairs(spark, sf_dir):
    """Pairs of sets of equal rows that share the top 16 bits; ``fingerprint_sets`` has the members of the sets."""
    return cluster.similar_pairs(written(photos(spark, sf_dir), "photos"), THRESHOLD).select("session_id", "a_id", "b_id", F.col("distance").cast("int").alias("distance"))


def fingerprint_sets(spark, sf_dir):
    return cluster.set_members(photos(spark, sf_dir))


def visual_members(spark, sf_dir):
    found = cluster.visual_members(_left(spark, sf_dir), THRESHOLD, cluster.all_bands(THRESHOLD))
    return found.select("session_id", "group_id", "file_id", S.confidence_percent(F.col("confidence")).alias("confidence_pct"))


def banded_pairs(spark, sf_dir):
    """All pairs within the threshold by seven bands, which one band would miss in part."""
    return cluster.similar_pairs(_left(spark, sf_dir), THRESHOLD, THRESHOLD + 1).drop("distance")


def shots_bursts(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    shots = events.select((F.col("user_id") % SHOT_SESSIONS).cast("string").alias("session_id"), F.col("event_id").alias("file_id"), F.col("ts").alias("date_taken"), F.col("event_type").alias("camera"))
    return cluster.burst_members(shots, SHOT_WINDOW).select("session_id", "group_id", "file_id")


def feed_bursts(spark, sf_dir):
    """All events as one feed without a gap, cut into chunks of 1,000 times."""
    events = _table(spark, sf_dir, "events")
    shots = events.select(F.lit("feed").alias("session_id"), F.col("event_id").alias("file_id"), F.col("ts").alias("date_taken"), F.col("event_type").alias("camera"))
    return cluster.burst_members(shots, FEED_WINDOW, chunk=1_000).select("group_id", "file_id")


def tiered_clusters(spark, sf_dir):
    files = written(photos(spark, sf_dir), "photos")
    found = cluster.tiered_members(files, ScanConfig(phash_threshold=THRESHOLD), PHOTO_WINDOW)
    return found.select("session_id", "kind", S.confidence_percent(F.col("confidence")).alias("confidence_pct"), "group_id", "file_id")


def incremental_clusters(spark, sf_dir):
    """All tiers after a first load and two deltas: inserts and deletes, then changes and the other deletes."""
    rows = written(photos(spark, sf_dir).select(incremental.FILE), "photos")
    number, none = F.col("file_id"), rows.select("file_id").limit(0)
    doomed, late, changed = number % 9 == 4, number % 5 == 0, number % 7 == 0
    older = {"content_hash": F.when(~changed, F.col("content_hash")), "phash": F.when(changed, F.shiftleft("phash", 1)).otherwise(F.col("phash")),
             "size": F.col("size") + F.when(changed, 1).otherwise(0), "date_taken": F.when(~changed, F.col("date_taken")).otherwise(F.col("date_taken") + F.expr("interval 30 minutes"))}
    state = incremental.empty(spark)
    for upserts, deletes in (
        (rows.where(~late).withColumns(older), none),
        (rows.where(late).withColumns(older), rows.where(doomed & (number % 2 == 0)).select("file_id")),
        (rows.where(changed & ~doomed), rows.where(doomed & (number % 2 == 1)).select("file_id")),
    ):
        state = incremental.apply(state, upserts, deletes, THRESHOLD, PHOTO_WINDOW)
    return state.members().select("session_id", "kind", S.confidence_percent(F.col("confidence")).alias("confidence_pct"), "group_id", "file_id")


def _inventory(spark, sf_dir):
    return _as_inventory(_table(spark, sf_dir, "documents"))


def _as_inventory(docs: DataFrame, *more) -> DataFrame:
    k = F.floor(F.col("doc_id") / 2)
    ends = [".JPG", ".ARW", ".JPG", ".tif", ".JPG", ".jpg", ".png", ".CR2", ".heic", ".txt"]
    ext = F.element_at(F.array(*map(F.lit, ends)), (F.col("doc_id") % 10 + 1).cast("int"))
    path = F.concat(F.lit("/lib/d"), (k % 7).cast("string"), F.lit("/IMG_"), k.cast("string"), ext)
    return docs.select("doc_id", F.lit("lib").alias("session_id"), path.alias("path"), F.col("n_chars").alias("size"), *more)


def companion_pairs(spark, sf_dir):
    return inventory.plan_scan(_inventory(spark, sf_dir), True).companions


def scan_entries(spark, sf_dir):
    plan = inventory.plan_scan(_inventory(spark, sf_dir), True)
    return inventory.attach_companions(plan.entries, plan.companions).select("doc_id", "path", "size", "companion_raw_path", "companion_raw_size")


def _snapshots(spark, sf_dir):
    rows = _inventory(spark, sf_dir)
    m = F.col("doc_id") % 10
    old = rows.where(m != 9).select(
        F.col("doc_id").alias("file_id"), "session_id", "path", "size", F.lit(1).cast("long").alias("mtime_ns"), F.lit(1).cast("long").alias("scan_generation"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    new = rows.where(m != 8).select("session_id", "path", "size", F.when(m == 5, 2).otherwise(1).cast("long").alias("mtime_ns"))
    return old, new


def snapshot_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return inventory.snapshot_diff(new, old).select("path", "change")


def rescanned_files(spark, sf_dir):
    """Upsert of new and changed files, then tombstones for missing ones; ids of new files are left out as they are hashes."""
    old, new = _snapshots(spark, sf_dir)
    files, _ = snapshot.rescan(old, new, lambda rows: rows, 2, NOW)
    return files.select(
        "path", F.when(F.col("path").endswith(".txt"), None).otherwise(F.col("file_id")).alias("file_id"), "size", "mtime_ns", "scan_generation",
        F.col("deleted_at").isNotNull().alias("deleted"),
    )


def _sessions(spark, sf_dir):
    langs = _table(spark, sf_dir, "documents").groupBy("lang").agg(F.max("doc_id").alias("last"))
    return langs.select(F.col("lang").alias("session_id"), F.timestamp_seconds(F.col("last")).alias("updated_at"))


def list_sessions(spark, sf_dir):
    files, groups, members, _ = _decided(spark, sf_dir)
    chosen = groups.where("group_id % 3 = 1").select("group_id")
    groups, _ = decisions.keep_all(groups, members, chosen)
    found = review.list_sessions(_sessions(spark, sf_dir), files, groups)
    return found.select("session_id", F.unix_seconds("updated_at").alias("updated_s"), "file_count", "pending_groups", "total_groups")


def list_groups_page(spark, sf_dir):
    files, groups, members, _ = _decided(spark, sf_dir)
    page = review.list_groups(groups, members, files, "en", "pending", limit=20, offset=5)
    return page.select("group_id", "member_count", "bytes_recoverable")


def group_details(spark, sf_dir):
    files, groups, members, _ = _decided(spark, sf_dir)
    found = review.group_details(groups, members, files, files.select("file_id"))
    line = F.transform("members", lambda m: F.concat_ws(":", m["file_id"].cast("string"), m["size"].cast("string"), F.coalesce(m["is_keeper"].cast("string"), F.lit("-"))))
    return found.select("group_id", "bytes_recoverable", F.coalesce(F.array_join(line, ","), F.lit("")).alias("members"))


def count_groups(spark, sf_dir):
    _, groups, _ = _groups(spark, sf_dir)
    return review.count_groups(groups)


def suggested_keepers(spark, sf_dir):
    files, _, members = _groups(spark, sf_dir)
    return review.suggested_keepers(members, files)


def next_groups(spark, sf_dir):
    _, groups, _ = _groups(spark, sf_dir)
    return review.next_groups(groups)


def applied_keepers(spark, sf_dir):
    _, _, members, _ = _decided(spark, sf_dir)
    return members.select("group_id", "file_id", "is_keeper")


def undo_decisions(spark, sf_dir):
    """Keepers after a log of events for each group: a decision by its number modulo 3, undone for one in five; where it divides by 4
    another decision and up to three undos, of which the last reach back to groups before."""
    _, groups, members = _groups(spark, sf_dir)
    members = members.withColumn("is_keeper", F.when(F.col("group_id") % 2 == 1, F.col("file_id") == F.col("group_id")))
    g = F.col("group_id")
    event = lambda at, op, when: F.when(when, F.struct((10 * g + at).alias("seq"), F.lit(op).alias("op")))
    more = g % 4 == 0
    listed = F.array(
        event(1, "keep", g % 3 == 0), event(1, "keep_all", g % 3 == 1), event(2, "undo", g % 5 == 0), event(3, "keep", more),
        event(4, "undo", more & (g % 8 == 0)), event(5, "undo", more & (g % 16 == 0)), event(6, "undo", more & (g % 32 == 0)),
    )
    events = groups.select("session_id", "group_id", F.explode(F.array_compact(listed)).alias("e"))
    events = written(events.select("session_id", "e.seq", "e.op", F.when(F.col("e.op") != "undo", g).alias("group_id")), "events")
    last = written(members.groupBy("group_id").agg(F.max("file_id").alias("last")), "last")
    ends = members.select("session_id", "group_id", "file_id").join(last, "group_id")
    at_first = ends.where("file_id = group_id").select("session_id", (10 * g + 1).alias("seq"), "file_id")
    keepers = at_first.unionByName(ends.where("file_id = last").select("session_id", (10 * g + 3).alias("seq"), "file_id"))
    groups, members = decisions.replayed(groups, members, events, keepers)
    return members.join(groups.select("group_id", "review_status"), "group_id").select("group_id", "file_id", "is_keeper", "review_status")


def kept_all(spark, sf_dir):
    _, groups, members = _groups(spark, sf_dir)
    groups, members = decisions.keep_all(groups, members, groups.where("group_id % 3 = 1").select("group_id"))
    return members.join(groups.select("group_id", "review_status"), "group_id").select("group_id", "file_id", "is_keeper", "review_status")


def _manifest(spark, sf_dir):
    files, groups, members, _ = _decided(spark, sf_dir)
    return files, groups, written(decisions.purge_manifest(members, files), "manifest")


def purge_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)[2]


def purge_result(spark, sf_dir):
    """Outcomes of a deletion that fails for files whose number ends in 4 and is not run for those that end in 7."""
    _, _, manifest = _manifest(spark, sf_dir)
    tried = manifest.where("file_id % 10 <> 7").select("path", (F.col("file_id") % 10 != 4).alias("ok"), F.when(F.col("file_id") % 10 == 4, "denied").alias("error"))
    found = decisions.purge_result(manifest, tried)
    return found.select("group_id", "trashed_count", "bytes_freed", F.array_join("errors", "; ").alias("errors"))


def deleted_session(spark, sf_dir):
    files, groups, members = _groups(spark, sf_dir)
    prints = files.select("file_id", "content_hash")
    left = snapshot.delete_session({"files": files, "fingerprints": prints, "groups": groups, "members": members}, "en")
    counts = [t.select(F.lit(n).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n")) for n, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def path_parts(spark, sf_dir):
    path = F.col("path")
    return _inventory(spark, sf_dir).select(
        "doc_id", S.parent_dir(path).alias("dir"), S.basename(path).alias("name"), S.file_stem(path).alias("stem"), S.extension_lower(path).alias("ext"),
        S.file_key(path).alias("key"), S.is_supported_image(path).alias("image"), S.is_standalone_raw(path).alias("raw"),
    )


def thumbnail_keys(spark, sf_dir):
    return _inventory(spark, sf_dir).select("doc_id", S.thumbnail_key(F.col("path"), F.col("size")).alias("thumbnail_key"))


def formatted_bytes(spark, sf_dir):
    size = F.col("n_chars") * F.col("n_chars") * F.col("n_chars")
    return _table(spark, sf_dir, "documents").select("doc_id", S.format_bytes(size).alias("shown"))


def camera_keys(spark, sf_dir):
    made = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    model = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("M"), (F.col("user_id") % 9).cast("string")))
    line = S.exif_line(made, model, (F.col("event_id") % 4 * 100).cast("int"), S.format_aperture(F.col("value").cast("int") / 4), F.lit(None), F.lit(""))
    return _table(spark, sf_dir, "events").select("event_id", S.camera_key(made, model).alias("camera"), line.alias("line"))


def shutter_texts(spark, sf_dir):
    q = F.col("l_quantity")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.format_shutter(q / 8).alias("slow"), S.format_shutter(1 / q).alias("quick"), S.format_focal(q / 2).alias("focal"))


def raster_hashes(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return rows.select("vec_id", text(P.gradient_hash(F.col("embedding"))).alias("dhash"), text(P.median_hash(F.col("embedding"))).alias("mhash"))


def dct_hashes(spark, sf_dir):
    found = _table(spark, sf_dir, "embeddings").select("vec_id", P.dct_hash(F.col("embedding")).alias("h"))
    return found.select("vec_id", F.lpad(F.lower(F.hex("h")), 16, "0").alias("phash"))


def streamed_events(spark, sf_dir):
    """Events ingested by the file stream in two runs, the second of which finds nothing new, then counted by type."""
    base = fresh_dir(spark, "stream")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _table(spark, sf_dir, "events").schema)
    process = lambda batch: batch.select("event_id", "event_type", "value")
    for _ in range(2):
        streaming.ingest(spark, f"{sf_dir}/events*", schema, f"{base}/table", f"{base}/state", process, files_per_batch=1).awaitTermination()
    table = spark.read.parquet(f"{base}/table")
    rows = streaming.latest(table, ["event_id"])
    found = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    again = table.groupBy("event_type").agg(F.count("*").alias("n_stored"))
    return found.join(again, found["event_type"].eqNullSafe(again["event_type"])).select(found["event_type"], "n", "last_id", "n_stored")


def stream_upsert(spark, sf_dir):
    """Two scans whose listings come as streams: the second finds files new, changed, unchanged and gone; its last batch is put twice and a compaction comes between."""
    base = fresh_dir(spark, "upserts")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _table(spark, sf_dir, "documents").schema)
    stored = upsert.SnapshotStream(spark, f"{base}/snapshot")
    m = F.col("doc_id") % 10
    prints = lambda rows: rows.select("file_id", "content_hash", F.col("size").alias("phash"))
    for generation, gone, mtime in ((1, 9, F.lit(1)), (2, 8, F.when(m == 5, 2).otherwise(1))):
        def listed(batch, gone=gone, mtime=mtime):
            rows = _as_inventory(batch.where(m != gone), S.content_hash(F.col("text")).alias("content_hash"))
            return rows.withColumn("mtime_ns", mtime.cast("long"))

        stored.ingest(f"{sf_dir}/documents*", schema, f"{base}/state-{generation}", generation, listed, prints, files_per_batch=1).awaitTermination()
        stored.close(generation, NOW)
        if generation == 1:
            stored.compact()
    stored.put(listed(_table(spark, sf_dir, "documents")), 2, 0, prints)
    stored.close(2, NOW)
    found = stored.state()
    return found.select("path", "size", "mtime_ns", "scan_generation", F.col("deleted_at").isNotNull().alias("deleted"), "content_hash", "phash")


def upserted_fingerprints(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("file_id"), S.content_hash(F.col("text")).alias("content_hash"), F.col("n_chars").alias("phash"))
    fresh = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 8 == 0, F.col("lang")).alias("content_hash"), F.lit(None).cast("long").alias("phash"))
    return snapshot.upsert_fingerprints(old, fresh)


def assembled_fingerprints(spark, sf_dir):
    """Files with content hashes and raster hashes; those without a raster are rejects."""
    rows = _inventory(spark, sf_dir)
    docs, rasters = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "embeddings")
    contents = rows.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").select("path", "content")
    hashes = rows.join(rasters, F.col("doc_id") == F.col("vec_id")).select(
        "path", F.lit(8).alias("width"), F.lit(8).alias("height"), P.gradient_hash(F.col("embedding")).alias("dhash"), P.median_hash(F.col("embedding")).alias("phash")
    )
    done, rejects = process.assemble(rows.select("doc_id", "path"), ScanConfig(), contents, hashes)
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    rejects = rejects.withColumn("rejected", F.lit(True))
    return done.withColumn("rejected", F.lit(False)).unionByName(rejects).select("doc_id", "content_hash", "width", text("phash").alias("phash"), "rejected")


def exif_dates(spark, sf_dir):
    ts = F.date_format(F.col("ts"), "yyyy:MM:dd HH:mm:ss")
    original = F.when(F.col("event_id") % 3 == 0, ts).when(F.col("event_id") % 3 == 1, "no date")
    plain = F.when(F.col("event_id") % 2 == 0, F.lit("2001:02:03 04:05:06"))
    return _table(spark, sf_dir, "events").select("event_id", F.date_format(S.exif_date(original, plain), "yyyy-MM-dd HH:mm:ss").alias("taken"))


def exif_tags(spark, sf_dir):
    """Raw tags to capture data, to JSON and back."""
    n, one = F.col("l_linenumber"), lambda c: F.array(c)
    tags = _table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("path"),
        one(F.concat(F.lit("\x00 "), F.col("l_returnflag"), F.lit("cam \x00"))).alias("make"), F.when(n % 2 == 0, one(F.col("l_linestatus"))).alias("model"),
        one(F.lit("bad")).alias("date_original"), one(F.lit("2020:01:02 03:04:05")).alias("date_plain"), one(n.cast("long") * 100).alias("iso"),
        one(F.col("l_quantity").cast("long")).alias("fnumber_num"), one(F.lit(4).cast("long")).alias("fnumber_den"),
        one(F.lit(1).cast("long")).alias("exposure_num"), one(F.col("l_quantity").cast("long")).alias("exposure_den"),
        one(F.col("l_quantity").cast("long")).alias("focal_num"), one(n.cast("long") % 2).alias("focal_den"),
    )
    found = process.exif_from_tags(tags).select("path", S.exif_struct(S.exif_json(F.col("exif"))).alias("e"))
    return found.select("path", "e.cameraMake", "e.cameraModel", "e.iso", "e.aperture", "e.shutterSpeed", "e.focalLength", F.date_format("e.dateTaken", "yyyy-MM-dd HH:mm:ss").alias("taken"))


def labels_and_codes(spark, sf_dir):
    at = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % k + 1).cast("int"))
    kind, status, phase = at(["exact", "visual", "burst", "metadata", "odd"], 5), at(["scanning", "paused", "odd"], 3), at(["walking", "hashing", "odd", "complete"], 4)
    return _table(spark, sf_dir, "events").select(
        "event_id", S.kind_label(kind).alias("kind"), S.status_label(S.coded(status, schemas.STATUSES)).alias("status"), S.phase_label(phase).alias("phase")
    )


def dimension_texts(spark, sf_dir):
    return photos(spark, sf_dir, prints=False).select("file_id", S.dimensions_text(F.col("width"), F.col("height")).alias("shown"))


def rfc3339_times(spark, sf_dir):
    text = S.rfc3339(F.col("ts").cast("timestamp"))
    back = S.parse_rfc3339(F.when(F.col("event_id") % 7 == 0, F.lit("no time")).otherwise(text))
    return _table(spark, sf_dir, "events").select("event_id", text.alias("text"), F.date_format(back, "yyyy-MM-dd HH:mm:ss").alias("back"))


def session_names(spark, sf_dir):
    k = F.col("c_custkey") % 3
    root = F.when(F.col("c_custkey") % 5 == 0, "/").otherwise(F.concat(F.lit("/lib/"), F.col("c_mktsegment"), F.lit("/")))
    return _table(spark, sf_dir, "customer").select("c_custkey", S.session_name(F.when(k == 1, "").when(k == 2, F.col("c_name")), root).alias("name"))


def _session_rows(spark, sf_dir):
    base = _sessions(spark, sf_dir)
    return base.select(
        "session_id", F.col("session_id").alias("name"), F.concat(F.lit("/lib/"), "session_id").alias("root_path"), F.lit("scanning").alias("status"),
        F.lit(PRESETS["exact_only"].to_json()).alias("config"), F.lit(4).cast("long").alias("scan_generation"), "updated_at",
    )


def session_changes(spark, sf_dir):
    rows = snapshot.set_status(snapshot.bump_generation(_session_rows(spark, sf_dir), "en", NOW), "en", "paused", NOW)
    now = F.col("updated_at") == F.lit(NOW)
    return rows.select("session_id", "status", "scan_generation", now.alias("touched"))


def session_settings(spark, sf_dir):
    """Root and configuration of every session, from texts with other presets, missing keys and malformed ones."""
    rows = _session_rows(spark, sf_dir)
    texts = F.when(F.col("session_id") == "en", F.lit(PRESETS["exact_only"].to_json())).when(F.col("session_id") == "de", '{"phashThreshold": 9}').otherwise("{not json")
    found = review.session_configs(rows.withColumn("config", texts))
    return found.select("session_id", F.col("root_path").alias("root"), F.col("exact_hash").alias("exact"), F.col("visual_similar").alias("visual"), F.col("phash_threshold").alias("threshold"), "burst_window_secs")


def session_progress(spark, sf_dir):
    _, groups, _ = _groups(spark, sf_dir)
    counts = _table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("session_id")).agg(F.count("*").alias("files_processed"), F.max("doc_id").alias("last_id"))
    return review.progress(counts, groups, "en").select("session_id", "files_processed", "last_id", "groups")


def observed_metrics(spark, sf_dir):
    """The metrics of each session, counted by the jobs that write its entries."""
    base = fresh_dir(spark, "metrics")
    table = metrics.Metrics(spark, f"{base}/reports")
    rows = _inventory(spark, sf_dir)
    for session, part in (("odd", F.col("doc_id") % 2 == 1), ("even", F.col("doc_id") % 2 == 0)):
        for share in (rows.where(part & (F.col("doc_id") % 3 == 0)), rows.where(part)):
            table.write(share, f"{base}/{session}", session, total=1_000_000)
    return table.progress().select("session_id", "phase", "files_processed", "files_total_estimate", "percent", "last_path")


def scan_totals(spark, sf_dir):
    files, groups, _ = _groups(spark, sf_dir)
    return streaming.scan_metrics(files, groups, 1_000_000, 10.0).select("files_processed", "files_total_estimate", "files_per_second", "percent", "groups_found")


def plain_entries(spark, sf_dir):
    """The scan plan without RAW files."""
    return inventory.plan_scan(_inventory(spark, sf_dir), False).entries.select("doc_id", "path")


def packed_bytes(spark, sf_dir):
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select("c_custkey", S.pack_bytes(F.array(k % 256, F.lit(None).cast("long"), (k * 7) % 256, k % 100)).alias("packed"))


def cleared_groups(spark, sf_dir):
    _, groups, members = _groups(spark, sf_dir)
    groups, members = snapshot.clear_groups(groups, members, "en")
    return members.join(groups.select("group_id", "kind"), "group_id").select("session_id", "group_id", "file_id", "kind")


def kept_and_purged(spark, sf_dir):
    """The smallest live file of each third group is kept, and the rest of those groups purged."""
    files, groups, members = _groups(spark, sf_dir)
    live = members.where("group_id % 3 = 0").join(files.where("deleted_at is null").select("file_id"), "file_id")
    chosen = live.groupBy("group_id").agg(F.array(F.min("file_id")).alias("keepers"))
    return decisions.keep_selected_and_purge(members, files, chosen)[1]


def purged_by_live_keepers(spark, sf_dir):
    """The smallest file of every group is kept, deleted or not: a group whose keeper is deleted loses nothing."""
    files, groups, members = _groups(spark, sf_dir)
    chosen = groups.select("group_id", F.array("group_id").alias("keepers"))
    return decisions.purge_manifest(decisions.apply_keepers(members, chosen), files)


def scanned_library(spark, sf_dir):
    """A whole scan over the second of two snapshots: live files with their exact groups."""
    old, new = _snapshots(spark, sf_dir)
    docs = _inventory(spark, sf_dir).select("doc_id", "path").join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    texts = docs.select("path", F.col("doc_id"), S.content_hash(F.col("text")).alias("content_hash"))
    prints = texts.where("doc_id % 10 <> 9").select(F.col("doc_id").alias("file_id"), "content_hash")
    sessions = _session_rows(spark, sf_dir).where("session_id = 'en'").withColumn("session_id", F.lit("lib"))
    files = old.withColumns({"companion_raw_path": F.lit(None).cast("string"), "companion_raw_size": F.lit(None).cast("long")})
    empty = lambda schema: spark.createDataFrame([], schema)
    before = scans.Tables(sessions, files, prints, empty(schemas.GROUPS), empty(schemas.MEMBERS))
    fingerprint = lambda rows: rows.join(texts.select("path", "content_hash"), "path").select("file_id", "content_hash")
    after = scans.scan(before, new, "lib", PRESETS["exact_only"], fingerprint, NOW)
    live = after.files.where("deleted_at is null").select("file_id", "path", "scan_generation")
    status = after.sessions.where("session_id = 'lib'").select("status")
    return live.join(after.members.select("file_id", "group_id"), "file_id", "left").join(status, F.lit(True)).select("path", "scan_generation", "group_id", "status")


def scanned_tiers(spark, sf_dir):
    """A whole scan with all three tiers. Two of three files have changed since the last one, and of those one in 17 cannot be fingerprinted."""
    rows = written(photos(spark, sf_dir).withColumn("session_id", F.lit("lib")), "photos")
    changed, lost = F.col("file_id") % 3 != 0, F.col("file_id") % 17 == 0
    exif = F.struct(F.col("date_taken").alias("dateTaken"), F.split_part("camera", F.lit("|"), F.lit(1)).alias("cameraMake"), F.lit(None).cast("string").alias("cameraModel"))
    prints = rows.select("file_id", "content_hash", "phash", exif.alias("exif"), "width", "height")
    old = rows.select(
        "file_id", "session_id", "path", "size", F.lit(1).cast("long").alias("mtime_ns"), *(F.when(~changed, F.col(c)).alias(c) for c in ("width", "height")),
        F.lit(1).cast("long").alias("scan_generation"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("string").alias("companion_raw_path"),
        F.lit(None).cast("long").alias("companion_raw_size"),
    )
    listing = rows.select("session_id", "path", "size", F.when(changed, 2).otherwise(1).cast("long").alias("mtime_ns"))
    sessions = _session_rows(spark, sf_dir).where("session_id = 'en'").withColumn("session_id", F.lit("lib"))
    empty = lambda schema: spark.createDataFrame([], schema)
    before = scans.Tables(sessions, old, prints.where(~changed).drop("width", "height"), empty(schemas.GROUPS), empty(schemas.MEMBERS))
    fingerprint = lambda todo: todo.select("file_id").join(prints.where(~lost), "file_id")
    after = scans.scan(before, listing, "lib", ScanConfig(phash_threshold=THRESHOLD), fingerprint, NOW, PHOTO_WINDOW)
    grouped = after.members.join(after.groups.select("group_id", "kind", "confidence"), "group_id")
    grouped = grouped.select("file_id", "group_id", "kind", S.confidence_percent(F.col("confidence")).alias("confidence_pct"))
    rejects = after.rejects.select("path", F.lit(True).alias("rejected"))
    return after.files.join(grouped, "file_id", "left").join(rejects, "path", "left").select(
        "file_id", "kind", "confidence_pct", "group_id", "width", "height", F.col("deleted_at").isNotNull().alias("deleted"), F.coalesce("rejected", F.lit(False)).alias("rejected")
    )


QUERIES = {
    f.__name__: f
    for f in (
        exact_groups, exact_members, text_fingerprints, simhash_prefix_pairs, visual_members, banded_pairs, shots_bursts, feed_bursts,
        tiered_clusters, incremental_clusters, companion_pairs, scan_entries, snapshot_diff, rescanned_files, list_sessions, list_groups_page,
        group_details, count_groups, suggested_keepers, next_groups, applied_keepers, undo_decisions, kept_all, purge_manifest,
        purge_result, deleted_session, path_parts, thumbnail_keys, formatted_bytes, camera_keys, shutter_texts,
        raster_hashes, dct_hashes, streamed_events, stream_upsert, fingerprint_sets, upserted_fingerprints, assembled_fingerprints, exif_dates,
        exif_tags, labels_and_codes, dimension_texts, rfc3339_times, session_names, session_changes, session_settings,
        session_progress, observed_metrics, scan_totals, plain_entries, packed_bytes, cleared_groups, kept_and_purged, purged_by_live_keepers, scanned_library, scanned_tiers,
    )
}

# --- SQL ---------------------------------------------------------------------------------------------------------------

PHOTOS = """photos as (
  select d.doc_id as file_id, d.lang as session_id, d.n_chars as size,
         case when d.doc_id % 11 <> 0 then 100 * length(cast(d.n_chars as varchar)) end as width,
         case when d.doc_id % 11 <> 0 then 100 * (1 + d.doc_id % 3) end as height,
         sha256(d.text) as content_hash, epoch_us(e.ts) as us, coalesce(e.event_type, '') || '|' as camera,
         '/lib/' || d.doc_id || '.jpg' as path,
         case when d.doc_id % 5 = 0 then '/lib/' || d.doc_id || '.ARW' end as companion_path,
         case when d.doc_id % 5 = 0 then 2 * d.n_chars end as companion_size, d.doc_id % 13 = 0 as deleted
  from documents d left join events e on e.event_id = d.doc_id
)"""

PRINTS = f"""words as (
  select doc_id, w, count(*) as n from (select doc_id, unnest(string_split(lower(text), ' ')) as w from documents)
  where w <> '' group by 1, 2
), bits as (
  select doc_id, sum(n) as n, {", ".join(f"sum(n * cast((h >> {b}) & 1 as bigint)) as b{b}" for b in range(64))}
  from (select doc_id, n, ('0x' || substr(md5(w), 1, 16))::ubigint as h from words) group by doc_id
), prints as (
  select doc_id, {" + ".join(f"(case when 2 * b{b} > n then {1 << b}::hugeint else 0 end)" for b in range(64))} as p from bits
), phashes as (select doc_id as file_id, cast(p as ubigint) as phash from prints)"""

EXACT = """exact as (
  select session_id, file_id, min(file_id) over (partition by session_id, content_hash) as group_id
  from photos where content_hash is not null
  qualify count(*) over (partition by session_id, content_hash) >= 2
)"""

LEFT = """rest as (
  select p.*, h.phash from photos p left join phashes h using (file_id) where p.file_id not in (select file_id from exact)
)"""


def _pairs(rows: str, prefix: bool) -> str:
    block = "and a.phash >> 48 = b.phash >> 48" if prefix else ""
    return f"""select a.session_id, a.file_id as a_id, b.file_id as b_id, bit_count(xor(a.phash, b.phash)) as distance
  from {rows} a join {rows} b on a.session_id = b.session_id and a.file_id < b.file_id {block}
   and (a.size = b.size or coalesce(a.width = b.width and a.height = b.height, false))
   and bit_count(xor(a.phash, b.phash)) <= {THRESHOLD}"""


def _visual(prefix: bool = False) -> str:
    return f"""edges as ({_pairs("rest", prefix)}
), both_ways as (select a_id as a, b_id as b from edges union all select b_id, a_id from edges
), reach as (
  select distinct a as id, a as root from both_ways union select r.id, e.b from reach r join both_ways e on e.a = r.root
), parts as (select id as file_id, min(root) as group_id from reach group by id
), least as (
  select x.group_id, min(bit_count(xor(p.phash, q.phash))) as d
  from parts x join parts y on x.group_id = y.group_id and x.file_id < y.file_id
  join rest p on p.file_id = x.file_id join rest q on q.file_id = y.file_id group by 1
), visual as (
  select r.session_id, x.group_id, x.file_id,
         cast(floor((1 - least(l.d, {THRESHOLD}) / {THRESHOLD}.0) * 100 + 0.5) as integer) as confidence_pct
  from parts x join least l using (group_id) join rest r on r.file_id = x.file_id
)"""


VISUAL = _visual()


def _bursts(rows: str, seconds: int) -> str:
    us = seconds * 1_000_000
    return f"""nexts as (
  select distinct session_id, us, min(us) over (partition by session_id order by us
         range between {us + 1} following and unbounded following) as next_us from {rows}
), anchors as (
  select session_id, min(us) as us from {rows} group by 1
  union all
  select a.session_id, n.next_us from anchors a join nexts n on n.session_id = a.session_id and n.us = a.us where n.next_us is not null
), anchored as (
  select a.session_id, a.us, arg_min(s.camera, s.file_id) as camera
  from anchors a join {rows} s on s.session_id = a.session_id and s.us = a.us group by 1, 2
), taken as (
  select a.session_id, a.us, s.file_id from anchored a join {rows} s on s.session_id = a.session_id
   and s.us between a.us and a.us + {us} and s.camera = a.camera
), bursts as (
  select session_id, min(file_id) over (partition by session_id, us) as group_id, file_id from taken
  qualify count(*) over (partition by session_id, us) >= 2
)"""


def _one_session(photos: str) -> str:
    """The photos of ``scanned_tiers``: one session, without those that got no fingerprint."""
    one = photos.replace("d.lang as session_id", "'lib' as session_id")
    return one.replace("on e.event_id = d.doc_id", "on e.event_id = d.doc_id where not (d.doc_id % 17 = 0 and d.doc_id % 3 <> 0)")


INVENTORY = """inventory as (
  select doc_id, 'lib' as session_id, n_chars as size,
         '/lib/d' || ((doc_id // 2) % 7) || '/IMG_' || (doc_id // 2) ||
         list_extract(['.JPG', '.ARW', '.JPG', '.tif', '.JPG', '.jpg', '.png', '.CR2', '.heic', '.txt'], cast(doc_id % 10 + 1 as integer)) as path
  from documents
), parts as (
  select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '([^/]*)$', 1) as name,
         regexp_extract(path, '([^/]*)\\.[^./]*$', 1) as stem, lower(regexp_extract(path, '\\.([^./]*)$', 1)) as ext
  from inventory
), kinds as (
  select *, ext in ('jpg', 'jpeg', 'png', 'gif', 'webp', 'tiff', 'tif', 'heic', 'heif') as image,
         list_position(['arw', 'cr2', 'tif'], ext) as rank from parts
), raws as (
  select dir, lower(stem) as stem, rank, max(path) as raw_path, arg_max(size, path) as raw_size
  from kinds where rank > 0 group by all
), pairs as (
  select k.session_id, k.path, arg_min(r.raw_path, r.rank) as companion_raw_path, arg_min(r.raw_size, r.rank) as companion_raw_size
  from kinds k join raws r on r.dir = k.dir and r.stem = lower(k.stem) and r.raw_path <> k.path
  where k.image group by 1, 2
)"""

OLD_AND_NEW = """old as (
  select *, 1 as mtime from inventory where doc_id % 10 <> 9
), new as (
  select *, case when doc_id % 10 = 5 then 2 else 1 end as mtime from inventory where doc_id % 10 <> 8
)"""

DECIDED = f"""{PHOTOS}, {EXACT}, areas as (
  select e.group_id, p.file_id, row_number() over (partition by e.group_id order by
         coalesce(p.width, 0) * coalesce(p.height, 0) desc, p.us asc nulls last, p.size desc, p.file_id) as n
  from exact e join photos p using (file_id)
), suggested as (select group_id, file_id from areas where n = 1
), ends as (select group_id, max(file_id) as last_id from exact group by 1
), members as (
  select e.session_id, e.group_id, e.file_id,
         case when e.group_id % 3 = 2 then null
              when e.group_id % 3 = 1 then true
              when e.group_id % 2 = 1 then e.file_id = x.last_id
              else e.file_id = s.file_id end as is_keeper
  from exact e join suggested s using (group_id) join ends x using (group_id)
), totals as (
  select m.group_id, count(*) as member_count,
         cast(coalesce(sum(case when not coalesce(m.is_keeper, false) then p.size + coalesce(p.companion_size, 0) end), 0) as bigint) as bytes_recoverable
  from members m join photos p using (file_id) group by 1
)"""

MANIFEST = """kept as (select distinct group_id from members join photos using (file_id) where is_keeper and not deleted
), loose as (
  select m.group_id, p.* from members m join kept using (group_id) join photos p using (file_id)
  where not coalesce(m.is_keeper, false) and not p.deleted
), manifest as (
  select group_id, file_id, 'primary' as role, path, size as bytes from loose
  union all
  select group_id, file_id, 'companion', companion_path, coalesce(companion_size, 0) from loose where companion_path is not null
)"""



def _hex(bits: list[str]) -> str:
    total = " + ".join(f"(case when {b} then {1 << i}::hugeint else 0 end)" for i, b in enumerate(bits))
    return f"lpad(lower(to_hex(cast({total} as ubigint))), 16, '0')"


_GRADIENT = [f"embedding[{8 * y + x + 1}] < embedding[{8 * y + x + 2}]" for y in range(8) for x in range(7)]
_MEDIAN = [f"embedding[{i + 1}]::double > m" for i in range(64)]

SETS = "sets as (select session_id, phash, size, width, height, min(file_id) as file_id from {} where phash is not null group by 1, 2, 3, 4, 5)"


def _dct() -> str:
    """The cosine transform of 8 x 8 values as SQL: rows first, then columns."""
    c = [[math.cos(math.pi * (2 * x + 1) * u / 16) for x in range(8)] for u in range(8)]
    rows = ", ".join(f"{' + '.join(f'{c[u][x]!r}::double * embedding[{8 * y + x + 1}]::double' for x in range(8))} as t{y}_{u}" for y in range(8) for u in range(8))
    both = ", ".join(" + ".join(f"{c[v][y]!r}::double * t{y}_{u}" for y in range(8)) for v in range(8) for u in range(8))
    bits = [f"w[{i + 1}] > m" for i in range(64)]
    return f"""with t as (select vec_id, {rows} from embeddings), waves as (select vec_id, [{both}] as w from t),
  middles as (select *, (list_sort(w)[32] + list_sort(w)[33]) / 2 as m from waves) select vec_id, {_hex(bits)} as phash from middles"""


ORACLE_SQL = {
    "exact_groups": f"""with {PHOTOS}, {EXACT} select e.session_id, e.group_id, count(*) as member_count,
  cast(sum(p.size + coalesce(p.companion_size, 0)) as bigint) as bytes_recoverable
  from exact e join photos p using (file_id) group by 1, 2 order by 1, 2""",
    "exact_members": f"with {PHOTOS}, {EXACT} select session_id, group_id, file_id from exact",
    "text_fingerprints": f"with {PRINTS} select file_id as doc_id, lpad(lower(to_hex(phash)), 16, '0') as phash from phashes",
    "simhash_prefix_pairs": f"""with {PHOTOS}, {PRINTS}, every as (select p.*, h.phash from photos p join phashes h using (file_id))
  , {SETS.format("every")} select session_id, a_id, b_id, cast(distance as integer) as distance from ({_pairs("sets", True)})""",
    "visual_members": f"with recursive {PHOTOS}, {PRINTS}, {EXACT}, {LEFT}, {VISUAL} select session_id, group_id, file_id, confidence_pct from visual",
    "shots_bursts": f"""with recursive shots as (
  select cast(user_id % {SHOT_SESSIONS} as varchar) as session_id, event_id as file_id, epoch_us(ts) as us, coalesce(event_type, '|') as camera from events where ts is not null
), {_bursts("shots", SHOT_WINDOW)} select session_id, group_id, file_id from bursts""",
    "feed_bursts": f"""with recursive shots as (
  select 'feed' as session_id, event_id as file_id, epoch_us(ts) as us, coalesce(event_type, '|') as camera from events where ts is not null
), {_bursts("shots", FEED_WINDOW)} select group_id, file_id from bursts""",
    "tiered_clusters": f"""with recursive {PHOTOS}, {PRINTS}, {EXACT}, {LEFT}, {VISUAL}, dated as (
  select session_id, file_id, us, camera from rest where us is not null and file_id not in (select file_id from visual)
), {_bursts("dated", PHOTO_WINDOW)}
select session_id, 'exact' as kind, 100 as confidence_pct, group_id, file_id from exact
union all select session_id, 'visual', confidence_pct, group_id, file_id from visual
union all select session_id, 'burst', 75, group_id, file_id from bursts""",
    "incremental_clusters": f"""with recursive {PHOTOS.replace("on e.event_id = d.doc_id", "on e.event_id = d.doc_id where d.doc_id % 9 <> 4")}, {PRINTS}, {EXACT}, {LEFT}, {VISUAL}, dated as (
  select session_id, file_id, us, camera from rest where us is not null and file_id not in (select file_id from visual)
), {_bursts("dated", PHOTO_WINDOW)}
select session_id, 'exact' as kind, 100 as confidence_pct, group_id, file_id from exact
union all select session_id, 'visual', confidence_pct, group_id, file_id from visual
union all select session_id, 'burst', 75, group_id, file_id from bursts""",
    "companion_pairs": f"with {INVENTORY} select * from pairs",
    "scan_entries": f"""with {INVENTORY} select k.doc_id, k.path, k.size, p.companion_raw_path, p.companion_raw_size
  from kinds k left join pairs p using (path) where k.image and k.path not in (select companion_raw_path from pairs)""",
    "snapshot_diff": f"""with {INVENTORY}, {OLD_AND_NEW} select coalesce(n.path, o.path) as path,
  case when o.path is null then 'new' when n.path is null then 'missing' when o.size = n.size and o.mtime = n.mtime then 'unchanged' else 'changed' end as change
  from old o full join new n on n.path = o.path""",
    "rescanned_files": f"""with {INVENTORY}, {OLD_AND_NEW} select coalesce(n.path, o.path) as path, o.doc_id as file_id, coalesce(n.size, o.size) as size,
  cast(coalesce(n.mtime, o.mtime) as bigint) as mtime_ns, cast(case when n.path is null then 1 else 2 end as bigint) as scan_generation, n.path is null as deleted
  from old o full join new n on n.path = o.path""",
    "list_sessions": f"""with {DECIDED} select p.session_id, max(p.file_id) as updated_s, count(*) filter (where not p.deleted) as file_count,
  (select count(distinct group_id) from members m where m.session_id = p.session_id and group_id % 3 <> 1) as pending_groups,
  (select count(distinct group_id) from members m where m.session_id = p.session_id) as total_groups
  from photos p group by 1 order by 2 desc, 1""",
    "list_groups_page": f"""with {DECIDED} select group_id, member_count, bytes_recoverable from totals
  where group_id in (select group_id from members where session_id = 'en') order by group_id limit 20 offset 5""",
    "group_details": f"""with {DECIDED}, shown as (
  select m.group_id, string_agg(p.file_id || ':' || p.size || ':' || coalesce(cast(m.is_keeper as varchar), '-'), ',' order by p.size desc, p.file_id) as members
  from members m join photos p using (file_id) where not p.deleted group by 1
) select group_id, bytes_recoverable, coalesce(members, '') as members from totals left join shown using (group_id)""",
    "count_groups": f'with {PHOTOS}, {EXACT} select session_id, count(distinct group_id) as "groups" from exact group by 1',
    "suggested_keepers": f"with {DECIDED} select group_id, file_id from suggested",
    "next_groups": f"""with {PHOTOS}, {EXACT}, g as (select distinct session_id, group_id from exact)
  select session_id, group_id, coalesce(lead(group_id) over (partition by session_id order by group_id),
         min(group_id) over (partition by session_id)) as next_group_id from g""",
    "applied_keepers": f"with {DECIDED} select group_id, file_id, is_keeper from members",
    "kept_all": f"""with {PHOTOS}, {EXACT} select group_id, file_id, case when group_id % 3 = 1 then true end as is_keeper,
  case when group_id % 3 = 1 then 'resolved' else 'pending' end as review_status from exact""",
    "undo_decisions": f"""with recursive {PHOTOS}, {EXACT}, g as (select distinct session_id, group_id from exact), listed as (
  select session_id, group_id, 10 * group_id + 1 as seq, case group_id % 3 when 0 then 'keep' else 'keep_all' end as op from g where group_id % 3 <> 2
  union all select session_id, group_id, 10 * group_id + 2, 'undo' from g where group_id % 5 = 0
  union all select session_id, group_id, 10 * group_id + 3, 'keep' from g where group_id % 4 = 0
  union all select session_id, group_id, 10 * group_id + 4, 'undo' from g where group_id % 8 = 0
  union all select session_id, group_id, 10 * group_id + 5, 'undo' from g where group_id % 16 = 0
  union all select session_id, group_id, 10 * group_id + 6, 'undo' from g where group_id % 32 = 0
), ordered as (select *, row_number() over (partition by session_id order by seq) as n from listed
), stacks as (
  select distinct session_id, cast(0 as bigint) as n, cast([] as bigint[]) as stack from g
  union all
  select s.session_id, o.n, case when o.op = 'undo' then list_slice(s.stack, 1, len(s.stack) - 1) else list_append(s.stack, o.seq) end
  from stacks s join ordered o on o.session_id = s.session_id and o.n = s.n + 1
), final as (select session_id, unnest(arg_max(stack, n)) as seq from stacks group by 1
), open as (select group_id, max(o.seq) as seq, arg_max(o.op, o.seq) as op from final f join ordered o using (session_id, seq) group by 1
), ever as (select group_id, bool_or(op = 'keep_all') as whole from ordered where op <> 'undo' group by 1
), ends as (select group_id, max(file_id) as last from exact group by 1
), held as (select *, case when group_id % 2 = 1 then file_id = group_id end as was from exact)
select h.group_id, h.file_id,
  case when p.op = 'keep_all' then true when p.op = 'keep' then h.file_id = case p.seq % 10 when 1 then h.group_id else x.last end
       when e.group_id is not null then coalesce(h.was, false) else h.was end as is_keeper,
  case when e.whole then 'resolved' else 'pending' end as review_status
from held h left join open p using (group_id) left join ever e using (group_id) join ends x using (group_id)""",
    "purge_manifest": f"with {DECIDED}, {MANIFEST} select * from manifest",
    "purge_result": f"""with {DECIDED}, {MANIFEST}, told as (
  select *, case file_id % 10 when 4 then 'denied' when 7 then 'not tried' end as error from manifest
), live as (select * from told where role = 'primary' or error is null)
select group_id, count(*) filter (where error is null) as trashed_count,
  cast(coalesce(sum(bytes) filter (where error is null), 0) as bigint) as bytes_freed,
  coalesce(string_agg(path || ': ' || error, '; ' order by path || ': ' || error) filter (where error is not null), '') as errors
from live group by 1""",
    "deleted_session": f"""with {PHOTOS}, {EXACT}
select 'files' as table_name, count(*) as n from photos where session_id <> 'en'
union all select 'fingerprints', count(*) from photos where session_id <> 'en'
union all select 'groups', count(distinct group_id) from exact where session_id <> 'en'
union all select 'members', count(*) from exact where session_id <> 'en'""",
    "path_parts": f"""with {INVENTORY} select doc_id, dir, name, stem, ext, lower(stem) || '.' || ext as key, image, ext in ('arw', 'cr2') as raw from kinds""",
    "thumbnail_keys": f"""with {INVENTORY} select doc_id, sha256(encode(path) || unhex(array_to_string(list_transform(range(7, -1, -1),
  lambda i: substr(lpad(to_hex(size), 16, '0'), 2 * i + 1, 2)), ''))) as thumbnail_key from inventory""",
    "formatted_bytes": """with sized as (select doc_id, n_chars * n_chars * n_chars as n from documents), scaled as (
  select doc_id, n, case when n < 1024 then 0 when n < 1048576 then 1 when n < 1073741824 then 2 when n < 1099511627776 then 3 else 4 end as i from sized
) select doc_id, case when n = 0 then '0 B' else printf('%.1f ', floor(n::double / (1024 ** i)::double * 10 + 0.5) / 10)
  || list_extract(['B', 'KB', 'MB', 'GB', 'TB'], i + 1) end as shown from scaled""",
    "camera_keys": """with c as (
  select event_id, case when event_id % 3 <> 0 then event_type end as make, case when event_id % 5 <> 0 then 'M' || (user_id % 9) end as model, value from events
) select event_id, coalesce(make, '') || '|' || coalesce(model, '') as camera,
  concat_ws(' · ', nullif(concat_ws(' ', nullif(make, ''), nullif(model, '')), ''), case when event_id % 4 <> 0 then 'ISO ' || (event_id % 4 * 100) end,
  'f/' || printf('%.1f', round_even(cast(trunc(value) as integer) / 4.0, 1))) as line from c""",
    "shutter_texts": """select l_orderkey, l_linenumber,
  case when l_quantity / 8 >= 1 then printf('%.1fs', round_even(l_quantity / 8, 1)) when l_quantity > 0 then '1/' || cast(floor(8 / l_quantity + 0.5) as bigint) end as slow,
  case when l_quantity <= 1 then printf('%.1fs', round_even(1 / l_quantity, 1)) else '1/' || cast(floor(l_quantity + 0.5) as bigint) end as quick,
  printf('%.0fmm', round_even(l_quantity / 2, 0)) as focal from lineitem""",
    "raster_hashes": f"""with r as (
  select vec_id, embedding, (list_sort(embedding)[32]::double + list_sort(embedding)[33]::double) / 2 as m from embeddings
) select vec_id, {_hex(_GRADIENT)} as dhash, {_hex(_MEDIAN)} as mhash from r""",
    "streamed_events": "select event_type, count(*) as n, max(event_id) as last_id, count(*) as n_stored from events group by 1",
    "stream_upsert": f"""with {INVENTORY}, {OLD_AND_NEW} select coalesce(new.path, old.path) as path, coalesce(new.size, old.size) as size, cast(coalesce(new.mtime, old.mtime) as bigint) as mtime_ns,
  cast(case when new.path is null then 1 else 2 end as bigint) as scan_generation, new.path is null as deleted, sha256(d.text) as content_hash,
  coalesce(new.size, old.size) as phash
  from old full join new on old.path = new.path join documents d on d.doc_id = coalesce(new.doc_id, old.doc_id)""",
    "dct_hashes": _dct(),
    "fingerprint_sets": f"""with {PHOTOS}, {PRINTS}, every as (select p.*, h.phash from photos p join phashes h using (file_id))
  select session_id, file_id, min(file_id) over (partition by session_id, phash, size, width, height) as set_id from every""",
    "banded_pairs": f"with {PHOTOS}, {PRINTS}, {EXACT}, {LEFT}, {SETS.format('rest')} select session_id, a_id, b_id from ({_pairs('sets', False)})",
    "upserted_fingerprints": """select doc_id as file_id, case when doc_id % 4 <> 0 then sha256(text) when doc_id % 8 = 0 then lang end as content_hash,
  case when doc_id % 4 <> 0 then n_chars end as phash from documents where doc_id % 5 <> 0 or doc_id % 4 = 0""",
    "assembled_fingerprints": f"""with r as (select vec_id, embedding, (list_sort(embedding)[32]::double + list_sort(embedding)[33]::double) / 2 as m from embeddings)
  select doc_id, sha256(text) as content_hash, case when vec_id is not null then 8 end as width,
         case when vec_id is not null then {_hex(_MEDIAN)} end as phash, vec_id is null as rejected from documents left join r on vec_id = doc_id""",
    "exif_dates": """select event_id, case when event_id % 3 = 0 and ts is not null then strftime(ts, '%Y-%m-%d %H:%M:%S')
  when event_id % 2 = 0 then '2001-02-03 04:05:06' end as taken from events""",
    "exif_tags": """select l_orderkey || '-' || l_linenumber as path, l_returnflag || 'cam' as "cameraMake",
  case when l_linenumber % 2 = 0 then l_linestatus end as "cameraModel", l_linenumber * 100 as iso,
  'f/' || printf('%.1f', round_even(trunc(l_quantity) / 4, 1)) as aperture,
  case when trunc(l_quantity) <= 1 then '1.0s' else '1/' || cast(trunc(l_quantity) as bigint) end as "shutterSpeed",
  case when l_linenumber % 2 = 1 then printf('%.0fmm', trunc(l_quantity)) end as "focalLength", '2020-01-02 03:04:05' as taken from lineitem""",
    "labels_and_codes": """select event_id, list_extract(['Exact copy', 'Visually similar', 'Burst sequence', 'Metadata match', 'odd'], cast(event_id % 5 + 1 as integer)) as kind,
  list_extract(['Scanning', 'Paused', 'Scanning'], cast(event_id % 3 + 1 as integer)) as status,
  list_extract(['Walking directories', 'Hashing photos', 'odd', 'Scan complete'], cast(event_id % 4 + 1 as integer)) as phase from events""",
    "dimension_texts": f"with {PHOTOS} select file_id, coalesce(width || '×' || height, '—') as shown from photos",
    "rfc3339_times": """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as text,
  case when event_id % 7 <> 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') end as back from events""",
    "session_names": """select c_custkey, case when c_custkey % 3 = 2 then c_name when c_custkey % 5 = 0 then 'Scan' else c_mktsegment end as name from customer""",
    "session_changes": """select distinct lang as session_id, case when lang = 'en' then 'paused' else 'scanning' end as status,
  cast(case when lang = 'en' then 5 else 4 end as bigint) as scan_generation, lang = 'en' as touched from documents""",
    "session_settings": """select distinct lang as session_id, '/lib/' || lang as root, true as exact, lang <> 'en' as visual,
  case when lang = 'de' then 9 else 6 end as threshold, 2 as burst_window_secs from documents""",
    "session_progress": f"""with {PHOTOS}, {EXACT} select 'en' as session_id, count(*) as files_processed, max(file_id) as last_id,
  (select count(distinct group_id) from exact where session_id = 'en') as "groups" from photos where session_id = 'en'""",
    "observed_metrics": f"""with {INVENTORY} select case when doc_id % 2 = 1 then 'odd' else 'even' end as session_id, 'hashing' as phase,
  count(*) as files_processed, 1000000 as files_total_estimate, 100.0::double * count(*) / 1000000 as percent, max(path) as last_path from inventory group by 1""",
    "scan_totals": f"""with {PHOTOS}, {EXACT} select count(*) as files_processed, 1000000 as files_total_estimate, count(*) / 10.0::double as files_per_second,
  100.0::double * count(*) / 1000000 as percent, (select count(distinct group_id) from exact) as groups_found from photos""",
    "plain_entries": f"with {INVENTORY} select doc_id, path from kinds where image",
    "packed_bytes": "select c_custkey, cast(c_custkey % 256 + 65536 * ((c_custkey * 7) % 256) + 16777216 * (c_custkey % 100) as bigint) as packed from customer",
    "cleared_groups": f"with {PHOTOS}, {EXACT} select session_id, group_id, file_id, 'exact' as kind from exact where session_id <> 'en'",
    "kept_and_purged": f"""with {PHOTOS}, {EXACT}, firsts as (
  select e.group_id, min(e.file_id) as first from exact e join photos p using (file_id) where not p.deleted and e.group_id % 3 = 0 group by 1
), members as (select e.*, e.file_id = f.first as is_keeper from exact e join firsts f using (group_id)), {MANIFEST} select * from manifest""",
    "purged_by_live_keepers": f"with {PHOTOS}, {EXACT}, members as (select *, file_id = group_id as is_keeper from exact), {MANIFEST} select * from manifest",
    "scanned_tiers": f"""with recursive {_one_session(PHOTOS)}, {PRINTS}, {EXACT}, {LEFT}, {_visual(True)}, dated as (
  select session_id, file_id, us, camera from rest where us is not null and file_id not in (select file_id from visual)
), {_bursts("dated", PHOTO_WINDOW)}, grouped as (
  select file_id, group_id, 'exact' as kind, 100 as confidence_pct from exact
  union all select file_id, group_id, 'visual', confidence_pct from visual union all select file_id, group_id, 'burst', 75 from bursts
), every as (
  select doc_id as file_id, doc_id % 17 = 0 and doc_id % 3 <> 0 as lost, case when doc_id % 11 <> 0 then 100 * length(cast(n_chars as varchar)) end as width,
         case when doc_id % 11 <> 0 then 100 * (1 + doc_id % 3) end as height from documents
) select file_id, kind, confidence_pct, group_id, case when not lost then width end as width, case when not lost then height end as height,
  lost as deleted, lost as rejected from every left join grouped using (file_id)""",
    "scanned_library": f"""with {INVENTORY}, live as (select k.path, k.doc_id, d.text from kinds k join documents d using (doc_id) where k.image and k.doc_id % 10 <> 8)
  select path, cast(2 + 3 as bigint) as scan_generation, case when count(*) over (partition by text) > 1 then min(doc_id) over (partition by text) end as group_id,
         'reviewing' as status from live""",
}

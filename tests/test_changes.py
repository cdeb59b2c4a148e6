"""What is kept up to date by deltas and streams against what is computed at once."""

import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from nearfold.operators import cluster, decisions, incremental, review
from nearfold.plans import schemas
from nearfold.plans.config import ScanConfig
from nearfold.sources import snapshot
from nearfold.streaming import upsert

T0 = dt.datetime(2024, 1, 1)
FILE = "session_id string, file_id long, content_hash string, phash long, size long, width int, height int, date_taken timestamp, camera string"


def test_deltas_give_the_groups_of_a_full_run(spark):
    rng = random.Random(8)

    def version(i):
        block = rng.randrange(4) << 60
        bits = sum(1 << rng.randrange(48) for _ in range(rng.randrange(4)))
        return (
            rng.choice("ab"), i, rng.choice([None, f"h{rng.randrange(40)}", f"u{rng.random()}"]), rng.choice([None, (block | bits) - (1 << 63)]), rng.choice([1, 2, 3]),
            *rng.choice([(5, 5), (6, 5), (None, None)]), rng.choice([None, T0 + dt.timedelta(seconds=rng.randrange(4000))]), rng.choice(["x|", "y|"]),
        )

    now, state = {}, incremental.empty(spark)
    for delta in range(3):
        upserts = {i: version(i) for i in (range(90) if not delta else rng.sample(range(130), 12))}
        deletes = set(rng.sample(range(130), 0 if not delta else 9))
        now = {i: v for i, v in (now | upserts).items() if i not in deletes}
        state = incremental.apply(state, spark.createDataFrame(list(upserts.values()), FILE), spark.createDataFrame([(i,) for i in deletes], "file_id long"), 4, 60)
    full = cluster.tiered_members(spark.createDataFrame(list(now.values()), FILE), ScanConfig(phash_threshold=4), 60)
    found, expected = (sorted(tuple(r) for r in df.select(cluster.MEMBER).collect()) for df in (state.members(), full))
    assert found == expected and {r[1] for r in expected} == {"exact", "visual", "burst"}
    assert state.files.count() == len(now)


def test_deltas_link_prints_that_differ_in_any_bits(spark):
    """A new node far in the top bits joins two components, and leaves them apart again."""
    row = lambda i, p: ("s", i, None, p, i if i != 9 else 1, 4 if i != 1 else None, 4, None, "x|")
    none = spark.createDataFrame([], "file_id long")
    groups = lambda s: sorted((r.group_id, r.file_id) for r in s.members().collect())
    state = incremental.apply(incremental.empty(spark), spark.createDataFrame([row(1, 0), row(2, 0xFF << 50), row(3, 0x7F << 50)], FILE), none)
    assert groups(state) == [(2, 2), (2, 3)]
    state = incremental.apply(state, spark.createDataFrame([row(9, 0xF << 53)], FILE), none)
    assert groups(state) == [(1, 1), (1, 2), (1, 3), (1, 9)]
    state = incremental.apply(state, spark.createDataFrame([], FILE), spark.createDataFrame([(9,)], "file_id long"))
    assert groups(state) == [(2, 2), (2, 3)]


def test_old_rows_meet_touched_keys_only(spark):
    """A delta that touches one of many groups rebuilds that one."""
    rows = [("s", i, f"h{i // 2}", None, 1, None, None, None, "x|") for i in range(60)]
    one = spark.createDataFrame([("s", 60, "h3", None, 1, None, None, None, "x|")], FILE)
    none = spark.createDataFrame([], "file_id long")
    state = incremental.apply(incremental.empty(spark), spark.createDataFrame(rows, FILE), none)
    asked = []
    real = cluster.exact_members
    try:
        cluster.exact_members = lambda files: asked.append(files.count()) or real(files)
        state = incremental.apply(state, one, none)
    finally:
        cluster.exact_members = real
    assert asked == [3] and state.members().groupBy("group_id").count().where("count = 3").count() == 1


def test_a_stream_that_dies_between_write_and_commit(spark, tmp_path):
    source, listing = str(tmp_path / "in"), "session_id string, path string, size long, mtime_ns long"
    rows = [("s", f"/p{i}.jpg", i, 1) for i in range(30)]
    spark.createDataFrame(rows, listing).repartition(3).write.parquet(source)
    stored = upsert.SnapshotStream(spark, str(tmp_path / "snapshot"))
    calls = []

    def prints(todo):
        calls.append(todo.count())
        return todo.select("file_id", F.concat(F.lit("h"), "path").alias("content_hash"), F.lit(640).alias("width")).where("size <> 7")

    class Dies(upsert.SnapshotStream):
        def put(self, batch, generation, batch_id, fingerprint):
            super().put(batch, generation, batch_id, fingerprint)
            if batch_id == 1:
                raise RuntimeError("lost")

    run = lambda s, g=1: s.ingest(source, listing, str(tmp_path / "state"), g, lambda b: b, prints, files_per_batch=1).awaitTermination()
    with pytest.raises(StreamingQueryException):
        run(Dies(spark, stored.path))
    first = {r.path for r in stored.files().collect()}
    (tmp_path / "snapshot/changes/seq=4294967999").mkdir()  # begun, not committed: no reader sees it
    run(stored)
    stored.close(1, T0)
    stored.close(1, T0)
    expected, _ = snapshot.rescan(
        spark.createDataFrame([], schemas.FILES), spark.createDataFrame(rows, listing),
        lambda todo: todo.select("file_id", F.concat(F.lit("h"), "path").alias("content_hash"), F.lit(640).alias("width")).where("size <> 7"), 1, T0,
    )
    columns = ["session_id", "path", "file_id", "size", "mtime_ns", "width", "scan_generation", "deleted_at"]
    everything = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert everything(stored.files()) == everything(expected) and len(first) < 29 == stored.files().count()
    assert sum(calls) == 40 and calls[1] == calls[2]  # the batch that was lost came again, and compared itself with the same state
    # a second scan after a compaction: one file changes, two are gone, the reject is tried again
    stored.compact()
    stored.compact()
    assert everything(stored.files()) == everything(expected)
    again = [(s, p, n + (n == 4), 1) for s, p, n, _ in rows if n not in (2, 3)]
    stored.put(spark.createDataFrame(again, listing), 2, 0, prints)
    stored.put(spark.createDataFrame(again, listing), 2, 0, prints)
    stored.close(2, T0)
    after, _ = snapshot.rescan(expected, spark.createDataFrame(again, listing), lambda t: t.select("file_id", F.lit(640).alias("width")).where(F.col("file_id").isNotNull() & (F.col("size") != 7)), 2, T0)
    live = lambda df: everything(df.where("deleted_at is null"))
    assert live(stored.files()) == live(after) and stored.files().where("deleted_at is not null").count() == 2
    assert stored.fingerprints().where("content_hash is null").count() == 0
    assert calls[-2:] == [2, 2]


def test_undo_takes_decisions_off_a_stack(spark):
    rng = random.Random(3)
    groups = [(g, "ab"[g % 2], "exact", 1.0, "pending") for g in range(6)]
    members = [(g, "ab"[g % 2], 10 * g + i, rng.choice([None, True, False])) for g in range(6) for i in range(3)]
    now, events, keepers, stacks, whole = {(g, f): k for g, _, f, k in members}, [], [], {"a": [], "b": []}, set()
    of = {g: [f for h, _, f, _ in members if h == g] for g in range(6)}
    for seq in range(120):
        session = rng.choice("ab")
        op = rng.choice(["keep", "keep_all", "undo", "undo"])
        g = rng.choice([x[0] for x in groups[:5] if x[1] == session])
        events.append((session, seq, op, None if op == "undo" else g))
        if op == "undo":
            if stacks[session]:
                g, held = stacks[session].pop()
                now |= {(g, f): f in held for f in of[g]}
            continue
        stacks[session].append((g, [f for f in of[g] if now[g, f]]))
        chosen = of[g] if op == "keep_all" else rng.sample(of[g], rng.randrange(3))
        whole |= {g} if op == "keep_all" else set()
        keepers += [(session, seq, f) for f in chosen if op == "keep"]
        now |= {(g, f): f in chosen for f in of[g]}
    frames = (
        spark.createDataFrame(groups, schemas.GROUPS), spark.createDataFrame(members, schemas.MEMBERS), spark.createDataFrame(events, "session_id string, seq long, op string, group_id long"),
        spark.createDataFrame(keepers, "session_id string, seq long, file_id long"),
    )
    done, kept = decisions.replayed(*frames)
    assert {(r.group_id, r.file_id): r.is_keeper for r in kept.collect()} == now and kept.count() == 18
    assert {r.group_id for r in done.where("review_status = 'resolved'").collect()} == whole
    _, same = decisions.replayed(*frames[:2], frames[2].limit(0), frames[3].limit(0))
    assert sorted(map(tuple, same.collect()), key=repr) == sorted(members, key=repr)


def test_listing_equals_a_walk(spark, tmp_path):
    import os

    from nearfold.sources import files, listing

    for name in ("a.JPG", "x/b.png", "x/y/c.jpg", "x/y/z/d e.jpg", "x/y/z/.hidden", "x/noext", "p/q/r/s/t.tif", "p/end."):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1" * len(name))
    os.symlink(tmp_path / "a.JPG", tmp_path / "x/link.jpg")
    os.symlink(tmp_path / "x", tmp_path / "loop")
    os.utime(tmp_path / "a.JPG", ns=(5, 1_700_000_000_123_456_789))
    walked = {}
    for folder, _, names in os.walk(tmp_path):
        for n in names:
            path = os.path.join(folder, n)
            if not os.path.islink(path):
                held = os.stat(path)
                walked[f"file:{path}"] = (held.st_size, held.st_mtime_ns, held.st_ino)
    for depth in (0, 1, 2, 9):
        df = listing.listed(spark, str(tmp_path), "s", depth=depth)
        assert {r.path: (r.size, r.mtime_ns, r.inode) for r in df.collect()} == walked and df.count() == len(walked)
    assert df.where("mtime_ns = 1700000000123456789").selectExpr("unix_micros(modified_at)").first()[0] == 1_700_000_000_123_456
    some = listing.listed(spark, str(tmp_path), "s", ["jpg", "tif"])
    assert {r.path.rpartition("/")[2] for r in some.collect()} == {"a.JPG", "c.jpg", "d e.jpg", "t.tif"}
    plain = {r.path for r in files.inventory(spark, str(tmp_path), "s").collect()}
    assert {p for p in walked if "hidden" not in p} <= plain | set()
    assert listing.listed(spark, str(tmp_path / "none"), "s").collect() == []


def test_capture_dates_are_utc_in_any_session(spark):
    from nearfold.functions import scalars as S

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = spark.range(1).select(F.unix_seconds(S.exif_date(F.lit("2024:07:01 12:00:00"), F.lit(None).cast("string"))).alias("t"), S.exif_date(F.lit("x"), F.lit("2024:07:01 25:00:00")).alias("bad")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row.t == int(dt.datetime(2024, 7, 1, 12, tzinfo=dt.timezone.utc).timestamp()) and row.bad is None


def test_replaced_partitions_may_come_from_the_table_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshot.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "id long, session_id string"), path)
    snapshot.write_partitions(spark.read.parquet(path).where("session_id = 'a'").selectExpr("id + 10 as id", "session_id"), path, ["a"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(2, "b"), (11, "a")]


def test_the_queue_of_one_session_is_cut_into_ranges(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice(["hot", "hot", "hot", "b", None]), "exact", rng.choice([1.0, 0.75, 0.5, None]), rng.choice(["pending", "pending", "resolved"])) for g in range(400)]
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(setting, "false")  # few rows would else be one range
        found = {r.group_id: r.next_group_id for r in review.next_groups(spark.createDataFrame(rows, schemas.GROUPS).repartition(7)).collect()}
    finally:
        spark.conf.unset(setting)
    expected = {}
    for session in ("hot", "b", None):
        queue = [r[0] for r in sorted((r for r in rows if r[1] == session and r[4] == "pending"), key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))]
        expected |= dict(zip(queue, [*queue[1:], queue[0]]))
    assert found == expected
    assert review.next_groups(spark.createDataFrame([], schemas.GROUPS)).collect() == []


def test_progress_survives_a_restart(spark, tmp_path):
    from nearfold.streaming import ingest, metrics

    table = metrics.Metrics(spark, str(tmp_path / "reports"))
    spark.createDataFrame([("/a", 1), ("/b", 2), ("/c", 3)], "path string, n long").repartition(3).write.parquet(str(tmp_path / "in"))
    for expected in (3, 5):
        listener = metrics.StreamReports(table, "s", total=10)
        spark.streams.addListener(listener)
        try:
            ingest.ingest(spark, str(tmp_path / "in"), "path string, n long", str(tmp_path / "out"), str(tmp_path / "state"), lambda b: b, files_per_batch=1).awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        finally:
            spark.streams.removeListener(listener)
        row = table.progress().first()
        assert (row.session_id, row.files_processed, row.percent, row.phase) == ("s", expected, 10.0 * expected, "hashing")
        spark.createDataFrame([("/d", 4), ("/e", 5)], "path string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table.write(spark.createDataFrame([("/z", 1)], "path string, n long").limit(0), str(tmp_path / "none"), "empty")
    assert table.progress().where("session_id = 'empty'").first()[2:6] == (0, 0, 0.0, 0.0)

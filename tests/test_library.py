"""Operators of the main library on literal rows and random ones."""

import datetime as dt
import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions import fingerprint as P, scalars as S
from nearfold.operators import cluster, components, decisions, inventory, process, review, scan
from nearfold.plans import schemas
from nearfold.plans.config import PRESETS, ScanConfig, resolve_config
from nearfold.sources import files as source, snapshot
from nearfold.streaming import ingest

FILE = "file_id long, session_id string, size long, width int, height int, content_hash string, phash long, date_taken timestamp, camera string"
T0 = dt.datetime(2024, 1, 1)


def one(spark, column, **values):
    row = spark.range(1).select(*(v.alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column).first()[0]


def frame(spark, rows):
    return spark.createDataFrame(rows, FILE)


def brute_clusters(rows, threshold):
    """Groups of similar rows by union-find over all pairs of one prefix."""
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    mask = (1 << 64) - 1
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[6] is None or b[6] is None or (a[6] & mask) >> 48 != (b[6] & mask) >> 48 or a[1] != b[1]:
                continue
            same = None not in (a[3], a[4], b[3], b[4]) and (a[3], a[4]) == (b[3], b[4])
            if (a[2] == b[2] or same) and ((a[6] ^ b[6]) & mask).bit_count() <= threshold:
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append(r)
    out = {}
    for g, held in groups.items():
        if len(held) > 1:
            least = min([threshold, *(((x[6] ^ y[6]) & mask).bit_count() for i, x in enumerate(held) for y in held[i + 1 :])])
            for r in held:
                out[r[0]] = (g, round(1 - least / max(threshold, 1), 5))
    return out


def test_two_similar_files(spark):
    print_ = 0x0123456789ABCDEF
    rows = [(31, "trip", 7040, 640, 426, None, print_, None, None), (44, "trip", 9900, 640, 426, None, print_ ^ 0x900, None, None), (45, "trip", 1, 2, 3, None, print_, None, None)]
    config = ScanConfig(exact_hash=False, burst_detection=False, phash_threshold=8)
    found = cluster.tiered_members(frame(spark, rows), config).collect()
    assert sorted((r.kind, r.group_id, r.file_id, r.confidence) for r in found) == [("visual", 31, 31, 0.75), ("visual", 31, 44, 0.75)]


def test_least_distance_of_members_that_are_no_link(spark):
    """Two members are joined by a third; they are nearer to each other than to it, but differ in size and shape."""
    rows = [(5, "s", 10, 4, 4, None, 0b0, None, None), (6, "s", 20, 4, 4, None, 0b1111, None, None), (7, "s", 20, 9, 9, None, 0b1, None, None)]
    found = cluster.visual_members(frame(spark, rows), 5).collect()
    assert {(r.group_id, r.file_id) for r in found} == {(5, 5), (5, 6), (5, 7)} and {round(r.confidence, 5) for r in found} == {0.8}


def test_components(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (5, 5), (7, None)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    assert found == {0: 0, 1: 0, 2: 0, 5: 5}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components.connected_components(chain, "a", "b").collect()} == {0}
    assert components.connected_components(edges.limit(0), "a", "b").collect() == []


@pytest.mark.parametrize(("threshold", "partitions"), [(0, 1), (3, 4), (6, 17), (64, 4)])
def test_visual_tier_against_brute_force(spark, threshold, partitions):
    rng = random.Random(threshold)
    bases = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(120):
        p = rng.choice(bases)
        for _ in range(rng.randrange(5)):
            p ^= 1 << rng.randrange(64)
        p = None if rng.random() < 0.05 else struct.unpack("q", struct.pack("Q", p))[0]
        side = rng.choice([None, 10, 20])
        rows.append((i, rng.choice("ab"), rng.randrange(3), side, 10, None, p, None, None))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = cluster.visual_members(frame(spark, rows).repartition(partitions), threshold).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r.file_id: (r.group_id, round(r.confidence, 5)) for r in found} == brute_clusters(rows, threshold)


def test_hot_prints_and_blocks_are_linear(spark):
    """One print with as many sizes as rows, and many prints around one another: few links for each row, one group each."""
    n = 20_000
    blank = spark.range(n).selectExpr("id as file_id", "'s' as session_id", "id + 1 as size", "640 as width", "480 as height", "0L as phash")
    ball = spark.range(n).selectExpr("id + 100000 as file_id", "'s' as session_id", "7L as size", "null as width", "null as height", "shiftleft(1L, 62) + shiftleft(1L, cast(id % 41 as int)) + shiftleft(1L, cast(id div 41 % 41 as int)) as phash")
    files = blank.unionByName(ball).withColumns({"width": F.col("width").cast("int"), "height": F.col("height").cast("int")})
    sets = files.groupBy("session_id", "phash", "size", "width", "height").agg(F.min("file_id").alias("id"))
    prints = sets.where("id >= 100000").count()
    links = cluster.component_links(sets, 6)
    assert links.count() <= 2 * n + 7 * prints
    groups = cluster.visual_members(files, 6).groupBy("group_id", "confidence").count().collect()
    assert sorted((r.group_id, r["count"], r.confidence) for r in groups) == [(0, n, 1.0), (100_000, n, 1.0)]


@pytest.mark.parametrize("threshold", [1, 2, 3, 5])
def test_confidence_of_far_members(spark, threshold):
    """Chains of prints, each a step from the next: the least distance is found at any radius."""
    rows, expected = [], {}
    for g in range(8):
        step = 1 + g % max(1, threshold)
        bits = 0
        for i in range(4):
            rows.append((100 * g + i, "s", g, None, None, None, (g << 48) | bits, None, None))
            bits |= ((1 << step) - 1) << (step * i)
            expected[100 * g + i] = round(1 - min(step, threshold) / threshold, 5)
    found = {r.file_id: round(r.confidence, 5) for r in cluster.visual_members(frame(spark, rows), threshold).collect()}
    assert found == expected


def test_bands_find_every_pair(spark):
    rng = random.Random(1)
    rows = [(i, "s", 1, None, None, None, rng.getrandbits(62) & 0xFF0000FF00FF, None, None) for i in range(150)]
    found = {(r.a_id, r.b_id) for r in cluster.similar_pairs(frame(spark, rows), 6, 7).collect()}
    first = {}
    for r in rows:
        first.setdefault(r[6], r[0])
    ids = sorted((i, p) for p, i in first.items())
    assert found == {(a, b) for k, (a, p) in enumerate(ids) for b, q in ids[k + 1 :] if (p ^ q).bit_count() <= 6}


def all_links(rows, threshold):
    """The least id each row reaches over links of all pairs, whatever bits differ."""
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            alike = a[2] is not None and a[2] == b[2] or None not in (*a[3:5], *b[3:5]) and a[3:5] == b[3:5]
            if a[1] == b[1] and alike and ((a[6] ^ b[6]) & ((1 << 64) - 1)).bit_count() <= threshold:
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    return {r[0]: find(r[0]) for r in rows}


def _prints_around(rng, n, bases, flips):
    found = []
    for _ in range(n):
        p = rng.choice(bases)
        for _ in range(rng.randrange(flips + 1)):
            p ^= 1 << rng.randrange(64)
        found.append(struct.unpack("q", struct.pack("Q", p))[0])
    return found


@pytest.mark.parametrize("limits", [(8_192, 16_384, 16_384), (4, 1_000, 50), (4, 6, 20)])
def test_no_link_within_the_threshold_is_left_out(spark, monkeypatch, limits):
    """Links that differ in any bits, by whole keys, by blocks and by tiles of two parts; as few links as rows of the tiles."""
    for name, limit in zip(("KEY_ROWS", "LINK_TILE_ROWS", "BUCKET_ROWS"), limits):
        monkeypatch.setattr(cluster, name, limit)
    rng = random.Random(limits[1])
    prints = _prints_around(rng, 260, [rng.getrandbits(64) for _ in range(12)], 7)
    shapes = [(1, 5, 5), (2, 5, 5), (None, 5, 5), (3, 6, 5), (None, 6, 5), (1, None, None), (2, None, None), (3, None, 5)]
    rows = [(i, rng.choice("ab"), *rng.choice(shapes), None, p, None, None) for i, p in enumerate(prints)]
    expected = all_links(rows, 6)
    members = lambda df: {r.file_id: r.group_id for r in df.collect()}
    grouped = {i: g for i, g in expected.items() if list(expected.values()).count(g) > 1}
    assert members(cluster.visual_members(frame(spark, rows), 6, cluster.all_bands(6))) == grouped
    prefix = members(cluster.visual_members(frame(spark, rows), 6))
    assert prefix != grouped and len(set(grouped.values())) > 10
    # where only some rows are asked, the links with an end in them, once the others are joined
    asked = {r[0] for r in rows if rng.random() < 0.3}
    sets = frame(spark, rows).withColumnRenamed("file_id", "id").withColumn("asked", F.col("id").isin(asked))
    links = {(r.a_id, r.b_id) for r in cluster.component_links(sets, 6, 7).collect()}
    root = all_links([r for r in rows if r[0] not in asked], 6) | {i: i for i in asked}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert expected[a] == expected[b]
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: find(i) for i in expected} == expected


def test_tiers_link_prints_that_differ_in_any_bits(spark):
    rows = [(1, "s", 10, 4, 4, None, 0b11, None, None), (2, "s", 20, 4, 4, None, 0b11 | 1 << 60, None, None), (3, "s", 10, None, None, None, -(1 << 63) | 0b11, None, None)]
    found = cluster.tiered_members(frame(spark, rows), ScanConfig(phash_threshold=6), 1).collect()
    assert sorted((r.kind, r.group_id, r.file_id) for r in found) == [("visual", 1, 1), ("visual", 1, 2), ("visual", 1, 3)]


def test_the_visual_query_links_prints_that_differ_in_any_bits(spark, monkeypatch):
    from nearfold import queries

    rows = [(1, "s", 10, 4, 4, "a", 0b11, None, None), (2, "s", 20, 4, 4, "b", 0b11 | 1 << 60, None, None), (3, "s", 30, 5, 5, "c", 0b11, None, None)]
    monkeypatch.setattr(queries, "photos", lambda spark, sf_dir, prints=True: frame(spark, rows))
    assert sorted((r.group_id, r.file_id, r.confidence_pct) for r in queries.visual_members(spark, "").collect()) == [(1, 1, 83), (1, 2, 83)]


def test_links_of_a_dense_ball_far_from_its_first_point(spark):
    """800 prints of which most pairs are links: fewer links than points for each way of being compatible, not a link for each pair."""
    rng = random.Random(2)
    ball = {sum(1 << b for b in rng.sample(range(24), 3)) | 0xFFF << 40 for _ in range(1200)}
    rows = [(0, "s", 7, None, None, None, 0, None, None)] + [(i + 1, "s", 7, None, None, None, p, None, None) for i, p in enumerate(sorted(ball)[:800])]
    assert sum((a[6] ^ b[6]).bit_count() <= 6 for a in rows[1:] for b in rows[1:]) > 500_000
    sets = frame(spark, rows).withColumnRenamed("file_id", "id")
    for bands in (1, 7):
        assert cluster.component_links(sets, 6, bands).count() == 799


def test_simhash_memory_is_bounded():
    """A batch of 20 MB of ever new words, in one long text and many short ones, takes a few times BYTES_AT_ONCE beside itself."""
    import tracemalloc

    import pyarrow as pa

    words = [f"w{i:09d}" for i in range(1_800_000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    expected = [_brute_simhash(t) for t in texts[::3000]]
    del words, texts
    tracemalloc.start()
    try:
        (found,) = P._simhash_batches(iter([batch]), "id")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.column(0).to_pylist() == list(range(18_000)) and found.column(1).to_pylist()[::3000] == expected
    assert peak < 150e6


def _brute_simhash(text):
    import hashlib

    prints = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in text.split(" ") if w]
    found = sum(1 << b for b in range(64) if 2 * sum(p >> b & 1 for p in prints) > len(prints))
    return found - (1 << 64) if found >> 63 else found


@pytest.mark.parametrize("band_count", [1, 7])
def test_pairs_of_large_blocks_by_tiles(spark, monkeypatch, band_count):
    """A dense block over the limits is compared by tiles: the same pairs as by brute force, with equal and unknown sizes and sides."""
    rng = random.Random(11)
    near = lambda: sum(1 << rng.randrange(60 if band_count > 1 else 50) for _ in range(rng.randrange(5)))
    rows = [(i, rng.choice("ab"), rng.choice([None, 1, 2]), *rng.choice([(5, 5), (6, 5), (None, None)]), None, near(), None, None) for i in range(300)]
    expected, first = {}, {}
    for r in rows:
        first.setdefault((r[1], r[6], r[2], r[3], r[4]), r)
    for a in first.values():
        for b in first.values():
            alike = a[2] is not None and a[2] == b[2] or a[3] is not None and a[3:5] == b[3:5]
            d = ((a[6] ^ b[6]) & ((1 << 64) - 1)).bit_count()
            if a[0] < b[0] and a[1] == b[1] and alike and d <= 6 and (band_count > 1 or (a[6] ^ b[6]) >> 48 == 0):
                expected[a[1], a[0], b[0]] = d
    for limits in ((8, 16), (256, 2048)):
        monkeypatch.setattr(cluster, "BLOCK_ROWS", limits[0])
        monkeypatch.setattr(cluster, "TILE_ROWS", limits[1])
        found = [tuple(r) for r in cluster.similar_pairs(frame(spark, rows), 6, band_count).collect()]
        assert len(found) == len(expected) > 1000 and {r[:3]: r[3] for r in found} == expected


def brute_bursts(rows, window):
    out = {}
    for s in {r[1] for r in rows}:
        dated = sorted((r for r in rows if r[1] == s and r[7]), key=lambda r: (r[7], r[0]))
        i = 0
        while i < len(dated):
            j, group = i + 1, [dated[i]]
            while j < len(dated) and (dated[j][7] - dated[i][7]).total_seconds() <= window:
                if dated[j][8] == dated[i][8]:
                    group.append(dated[j])
                j += 1
            if len(group) > 1:
                out |= {r[0]: min(g[0] for g in group) for r in group}
            i = j
    return out


@pytest.mark.parametrize(("window", "fold"), [(0, 2000), (60, 2000), (60, 3), (5000, 4), (200_000, 5)])
def test_bursts_against_a_loop(spark, monkeypatch, window, fold):
    monkeypatch.setattr(cluster, "CHUNK", fold)
    rng = random.Random(window)
    rows = [
        (i, rng.choice("ab"), 1, None, None, None, None, rng.random() > 0.05 and T0 + dt.timedelta(seconds=rng.choice([30, 60, 90_000]) * rng.randrange(12)) or None, rng.choice(["x|", "y|"]))
        for i in range(150)
    ]
    found = {r.file_id: r.group_id for r in cluster.burst_members(frame(spark, rows), window).collect()}
    assert found == brute_bursts(rows, window)


@pytest.mark.parametrize(("window", "chunk"), [(7, 40), (45, 25), (700, 30), (100_000, 60)])
def test_one_session_without_a_gap_is_folded_by_chunks(spark, monkeypatch, window, chunk):
    """No task holds more than a few chunks, and windows may span several of them."""
    monkeypatch.setattr(cluster, "CHUNK", chunk)
    rng = random.Random(chunk)
    at, rows = 0, []
    for i in range(600):
        at += rng.choice([0, 1, 2, 5])
        rows.append((i * 7 % 601, "s" if i else "t", 1, None, None, None, None, T0 + dt.timedelta(seconds=at), rng.choice(["x|", "y|", "z|"])))
    held = []
    fold = cluster._chunked

    def spy(times, size):
        found, parts = fold(times, size)
        held.append((parts, found.groupBy("session_id", "chunk").count().agg({"count": "max"}).first()[0]))
        return found, parts

    monkeypatch.setattr(cluster, "_chunked", spy)
    found = {r.file_id: r.group_id for r in cluster.burst_members(frame(spark, rows), window).collect()}
    assert found == brute_bursts(rows, window)
    assert held[0][0] > 5 and held[0][1] <= 3 * chunk


def test_tiers_exclude_what_is_taken(spark):
    day = [T0 + dt.timedelta(seconds=i) for i in range(8)]
    rows = [(i, "s", 10 + (i > 1), 5, 5, "h" if i < 2 else f"h{i}", 1 << min(i, 40) // 9, day[i], "c|") for i in range(8)]
    found = cluster.tiered_members(frame(spark, rows), ScanConfig(phash_threshold=0)).collect()
    assert len({r.file_id for r in found}) == len(found) and {r.kind for r in found if r.file_id < 2} == {"exact"}
    off = ScanConfig(exact_hash=False, visual_similar=False, burst_detection=False)
    assert cluster.tiered_members(frame(spark, rows), off).collect() == []


@pytest.mark.parametrize(
    ("paths", "raw", "entries", "companions"),
    [
        (["/trip/lake 01.jpeg", "/trip/lake 01.nef", "/trip/boat.heic"], True, ["/trip/lake 01.jpeg", "/trip/boat.heic"], {"/trip/lake 01.jpeg": "/trip/lake 01.nef"}),
        (["/trip/Kite.png", "/trip/kite.TIF"], True, ["/trip/Kite.png"], {"/trip/Kite.png": "/trip/kite.TIF"}),
        (["/trip/alone.tiff", "/trip/alone.orf"], False, ["/trip/alone.tiff"], {}),
        (["/trip/only.tif"], True, ["/trip/only.tif"], {}),
        (["/trip/oak.webp", "/trip/oak.dng"], False, ["/trip/oak.webp"], {}),
        (["/p/D1.JPG", "/p/D1.tif", "/p/D1.arw", "/p/D1.3fr"], True, ["/p/D1.JPG", "/p/D1.tif"], {"/p/D1.JPG": "/p/D1.3fr", "/p/D1.tif": "/p/D1.3fr"}),
        (["/p/.hidden", "/p/noext", "/q/D1.JPG", "/p/D1.ARW"], True, ["/q/D1.JPG"], {}),
    ],
)
def test_scan_plans(spark, paths, raw, entries, companions):
    plan = inventory.plan_scan(spark.createDataFrame([("s", p, 1) for p in paths], "session_id string, path string, size long"), raw)
    assert sorted(r.path for r in plan.entries.collect()) == sorted(entries)
    assert {r.path: r.companion_raw_path for r in plan.companions.collect()} == companions


def test_paths_and_texts(spark):
    L = F.lit
    assert [one(spark, S.extension_lower(L(p))) for p in ("/a/x.tar.JPG", "/a/.hidden", "/a/noext", "/a.b/c")] == ["jpg", None, None, None]
    assert [one(spark, S.file_stem(L(p))) for p in ("/a/x.tar.JPG", "/a/.hidden", "noext")] == ["x.tar", ".hidden", "noext"]
    assert one(spark, S.file_key(L("/a/X.Tar.JPG"))) == "x.tar.jpg" and one(spark, S.file_key(L("/a/x"))) is None
    assert [one(spark, S.parent_dir(L(p))) for p in ("/a", "a", "/a/b")] == ["/", "", "/a"]
    for size in (0, 1, 255, 1 << 40):
        assert one(spark, S.thumbnail_key(L("/é.jpg"), L(size))) == hashlib.sha256("/é.jpg".encode() + struct.pack("<Q", size)).hexdigest()
    assert [one(spark, S.format_bytes(L(n).cast("long"))) for n in (0, 1, 1023, 1536, 1 << 40, 1 << 52)] == ["0 B", "1.0 B", "1023.0 B", "1.5 KB", "1.0 TB", "4096.0 TB"]
    assert [one(spark, S.format_aperture(L(v))) for v in (2.25, 0.25, 2.8)] == ["f/2.2", "f/0.2", "f/2.8"]
    assert [one(spark, S.format_focal(L(v))) for v in (2.5, 50.0)] == ["2mm", "50mm"]
    assert [one(spark, S.format_shutter(L(v))) for v in (2.0, 1.0, 0.004, 0.0)] == ["2.0s", "1.0s", "1/250", None]
    assert one(spark, S.exif_line(L("A"), L(""), L(100), L("f/2.0"), L(None).cast("string"), L("50mm"))) == "A · ISO 100 · f/2.0 · 50mm"
    assert [one(spark, S.dimensions_text(L(w), L(2))) for w in (3, 0)] == ["3×2", "—"]
    assert one(spark, S.kind_label(L("burst"))) == "Burst sequence" and one(spark, S.kind_label(L("new"))) == "new"
    assert one(spark, S.status_label(L("reviewing"))) == "Ready to review" and one(spark, S.phase_label(L("walking"))) == "Walking directories"
    assert one(spark, S.coded(L("odd"), schemas.STATUSES)) == "scanning"
    assert [one(spark, S.session_name(L(None).cast("string"), L(r))) for r in ("/a/pics/", "/")] == ["pics", "Scan"]
    assert [one(spark, S.confidence_percent(L(c))) for c in (0.745, 1.0)] == [75, 100]
    assert one(spark, S.exif_date(L("bad"), L("2024:02:03 04:05:06"))) == dt.datetime(2024, 2, 3, 4, 5, 6)
    assert one(spark, S.clean_ascii(F.array(L("\0 Canon \0\0"), L("x")))) == "Canon"
    assert one(spark, S.parse_rfc3339(L("no date"))) is None
    assert one(spark, S.rfc3339(L(T0))) == "2024-01-01T00:00:00.000000Z"
    assert len(one(spark, S.new_session_id())) == 36


def test_bits(spark):
    assert one(spark, S.prefix16(F.lit(-1).cast("long"))) == 65535
    assert one(spark, S.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64
    parts = [1, 2, 3, 4, 5, 6, 7, 200]
    assert one(spark, S.pack_bytes(F.array(*map(F.lit, parts)))) == struct.unpack("<q", bytes(parts))[0]
    values = [float(zlib.crc32(bytes([i])) % 97) for i in range(64)]
    raster = F.array(*map(F.lit, values))
    grid = np.array(values).reshape(8, 8)
    pack = lambda bits: struct.unpack("q", struct.pack("Q", sum(1 << i for i, b in enumerate(bits) if b)))[0]
    assert one(spark, P.gradient_hash(raster)) == pack((grid[:, :-1] < grid[:, 1:]).ravel())
    assert one(spark, P.median_hash(raster)) == pack((grid > np.median(grid)).ravel())
    basis = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(8) + 1) / 16)
    waves = basis @ grid @ basis.T
    assert one(spark, P.dct_hash(raster)) == pack((waves > np.median(waves)).ravel())


def test_exif_json(spark):
    text = '{"cameraMake":"A","iso":100,"dateTaken":"2024-01-01T00:00:00Z"}'
    got = one(spark, S.exif_struct(F.lit(text)))
    assert (got.cameraMake, got.iso, got.dateTaken) == ("A", 100, T0)
    assert [one(spark, S.exif_struct(F.lit(t).cast("string"))) for t in ("{broken", None, "{}")] == [None] * 3
    assert '"cameraMake":"A"' in one(spark, S.exif_json(S.exif_struct(F.lit(text))))


def test_exif_from_tags(spark):
    schema = "path string, make array<string>, model array<string>, date_original array<string>, date_plain array<string>, iso array<long>, fnumber_num array<long>, fnumber_den array<long>, exposure_num array<long>, exposure_den array<long>, focal_num array<long>, focal_den array<long>"
    rows = [("a", ["Canon\0"], None, ["x"], ["2024:01:01 00:00:00"], [200], [28], [10], [1], [250], [50], [1]), ("b", [], [], [], [], [], [1], [0], None, None, None, None)]
    a, b = (r.exif for r in process.exif_from_tags(spark.createDataFrame(rows, schema)).orderBy("path").collect())
    assert (a.cameraMake, a.dateTaken, a.iso, a.aperture, a.shutterSpeed, a.focalLength) == ("Canon", T0, 200, "f/2.8", "1/250", "50mm")
    assert set(b) == {None}


def test_configs():
    assert resolve_config() == ScanConfig() == PRESETS["visual_similar"] and PRESETS["burst_time_window"].burst_window_secs == 3
    mine = ScanConfig(phash_threshold=1, include_raw=True)
    assert resolve_config("exact_only", mine).include_raw and resolve_config("exact_only", mine).phash_threshold == 6
    assert resolve_config("custom", mine) == mine
    assert ScanConfig.from_json(mine.to_json()) == mine and ScanConfig.from_json("{bad") == ScanConfig.from_json(None) == ScanConfig()
    assert ScanConfig.from_json('{"phashThreshold": 9}').phash_threshold == 9


def png(pixels):
    h, w = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = np.add.outer(np.arange(64), np.arange(72)).astype(np.uint8)
    pictures = {"a": base, "b": np.clip(base + rng.integers(0, 3, base.shape), 0, 255).astype(np.uint8), "c": rng.integers(0, 255, base.shape).astype(np.uint8)}
    (tmp_path / "d").mkdir()
    for name, p in pictures.items():
        (tmp_path / "d" / f"{name}.png").write_bytes(png(p))
    (tmp_path / "bad.png").write_bytes(b"no image")
    inv = source.inventory(spark, str(tmp_path), "s", "*.png")
    assert inv.count() == 4 and inv.where("size > 0 and mtime_ns > 0").count() == 4
    images = source.images(spark, str(tmp_path))
    hashes = P.image_hashes(images)
    got = {r.path.rpartition("/")[2]: r for r in hashes.collect()}
    assert (got["a.png"].width, got["a.png"].height) == (72, 64)
    mask = (1 << 64) - 1
    near = ((got["a.png"].phash ^ got["b.png"].phash) & mask).bit_count()
    far = ((got["a.png"].phash ^ got["c.png"].phash) & mask).bit_count()
    assert near < 16 < far or near < far
    contents = source.contents(spark, str(tmp_path))
    done, rejects = process.assemble(inv, ScanConfig(), contents, hashes)
    assert sorted(r.path.rpartition("/")[2] for r in done.collect()) == ["a.png", "b.png", "c.png"]
    assert [r.path.rpartition("/")[2] for r in rejects.collect()] == ["bad.png"]
    assert {r.content_hash for r in done.collect()} == {hashlib.sha256(png(p)).hexdigest() for p in pictures.values()}
    exact, none = process.assemble(inv, PRESETS["exact_only"], contents, hashes)
    assert exact.count() == 4 and none.count() == 0 and exact.where("phash is not null").count() == 0


def test_hashes_do_not_depend_on_tiles(spark, tmp_path):
    """Odd sizes, one row, one column and wide rows cut in parts, against sums over pixels repeated to whole cells."""
    rng = np.random.default_rng(1)
    shapes = [(64, 72), (61, 53), (1, 400), (400, 1), (3, 1000), (8, 9), (5, 7)]
    pictures = {f"{i}.png": rng.integers(0, 256, s).astype(np.uint8) for i, s in enumerate(shapes)} | {"flat.png": np.full((50, 30), 7, np.uint8)}
    for name, p in pictures.items():
        (tmp_path / name).write_bytes(png(p))
    (tmp_path / "bad.png").write_bytes(b"no image")
    images = source.images(spark, str(tmp_path))

    def cells(p, rows, columns):
        fine = np.repeat(np.repeat(p.astype(np.int64), rows, 0), columns, 1)
        return fine.reshape(rows, p.shape[0], columns, p.shape[1]).sum((1, 3))

    basis = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(8) + 1) / 16)
    bits = lambda marks: sum(1 << i for i, b in enumerate(marks.ravel()) if b)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    expected = {}
    for name, p in pictures.items():
        wide, waves = cells(p, 8, 9), basis @ (cells(p, 8, 8) / p.size) @ basis.T
        expected[name] = (p.shape[1], p.shape[0], signed(bits(wide[:, :-1] < wide[:, 1:])), signed(bits(waves > np.median(waves))))
    for size in (1, 100, 1 << 20):
        tiles = P.image_tiles(images, size)
        assert tiles.where(F.length("data") > size).count() == 0
        assert tiles.agg(F.sum(F.length("data"))).first()[0] == sum(p.size for p in pictures.values())
        got = {r.path.rpartition("/")[2]: tuple(r)[1:] for r in P.image_hashes(images, size).collect()}
        assert got.pop("bad.png") == (None,) * 4
        assert {n: r[:3] for n, r in got.items()} == {n: r[:3] for n, r in expected.items()}
        assert all(got[n][3] == expected[n][3] for n in got if n != "flat.png")  # equal cells: the signs of the waves are rounding
    assert P.image_hashes(images.limit(0)).count() == 0
    twice = P.image_hashes(images.unionAll(images)).groupBy("path").agg(F.count_distinct("dhash", "phash", "width")).collect()
    assert sorted(r[1] for r in twice) == [0] + [1] * len(pictures)


def library(spark):
    """One group of three: 12 has the largest area, 15 is deleted, 11 has a RAW file beside it."""
    files = spark.createDataFrame(
        [(11, "alps", "/lib/x/ridge.png", 730, 900, 700, None, "/lib/x/ridge.nef", 2100, None), (12, "alps", "/lib/y/ridge (1).png", 640, 1800, 1400, None, None, None, None), (15, "alps", "/lib/z.png", 90, None, None, T0, None, None, None)],
        "file_id long, session_id string, path string, size long, width int, height int, deleted_at timestamp, companion_raw_path string, companion_raw_size long, date_taken timestamp",
    )
    members = spark.createDataFrame([(11, "alps", i, None) for i in (11, 12, 15)], schemas.MEMBERS)
    groups = spark.createDataFrame([(11, "alps", "visual", 0.9, "pending")], schemas.GROUPS)
    return files, groups, members


def test_review_and_purge(spark):
    files, groups, members = library(spark)
    row = review.list_groups(groups, members, files).first()
    assert (row.member_count, row.bytes_recoverable) == (3, 3560)
    detail = review.group_detail(groups, members, files.withColumn("modified_at", F.lit(T0)), files.select("file_id"), 11).first()
    assert [m.file_id for m in detail.members] == [11, 12]
    one = detail.members[1]
    key = hashlib.sha256("/lib/y/ridge (1).png".encode() + (640).to_bytes(8, "little")).hexdigest()
    assert (one.file_name, one.created_at, one.modified_at, one.thumbnail_key) == ("ridge (1).png", None, T0, key)
    with pytest.raises(review.NotFound):
        review.group_detail(groups, members, files, files.select("file_id"), 12)
    assert review.suggested_keepers(members, files).first().file_id == 12
    with pytest.raises(decisions.NoKeeper):
        decisions.purge_manifest(members, files, groups.select("group_id"))
    log = spark.createDataFrame([(11, 1, [12], False), (11, 2, [11], True)], "group_id long, seq int, keepers array<long>, undone boolean")
    kept = decisions.apply_keepers(members, decisions.latest_decisions(log))
    assert {r.file_id: r.is_keeper for r in kept.collect()} == {11: False, 12: True, 15: False}
    manifest = decisions.purge_manifest(kept, files, groups.select("group_id"))
    gone = [("companion", "/lib/x/ridge.nef", 2100), ("primary", "/lib/x/ridge.png", 730)]
    assert sorted((r.role, r.path, r.bytes) for r in manifest.collect()) == gone
    choice = spark.createDataFrame([(11, [12])], "group_id long, keepers array<long>")
    at_once, listed = decisions.keep_selected_and_purge(members, files, choice)
    assert sorted((r.role, r.path, r.bytes) for r in listed.collect()) == gone and at_once.where("is_keeper").first().file_id == 12
    with pytest.raises(decisions.NoKeeper):
        decisions.keep_selected_and_purge(members, files, spark.createDataFrame([(11, [99])], choice.schema))
    outcome = lambda ok: spark.createDataFrame([("/lib/x/ridge.png", ok, None), ("/lib/x/ridge.nef", True, None)], "path string, ok boolean, error string")
    done = decisions.apply_purge(files, groups, manifest, outcome(True), T0)
    assert done.result.first()[1:3] == (2, 2830) and done.groups.first().review_status == "resolved"
    assert done.files.where("file_id = 11").first().deleted_at == T0
    failed = decisions.apply_purge(files, groups, manifest, outcome(False), T0)
    assert failed.result.first()[1:] == (0, 0, ["/lib/x/ridge.png: failed"]) and failed.groups.first().review_status == "pending"
    every = decisions.apply_keepers(members, spark.createDataFrame([(11, [11, 12, 15])], "group_id long, keepers array<long>"))
    assert decisions.purge_manifest(every, files, groups.select("group_id")).collect() == []


def test_deleted_keepers_keep_nothing(spark):
    files, groups, members = library(spark)
    choice = lambda *ids: spark.createDataFrame([(11, list(ids))], "group_id long, keepers array<long>")
    kept = decisions.apply_keepers(members, choice(15))  # 15 is deleted
    assert decisions.purge_manifest(kept, files).collect() == []
    with pytest.raises(decisions.NoKeeper):
        decisions.keep_selected_and_purge(members, files, choice(15))
    _, listed = decisions.keep_selected_and_purge(members, files, choice(12, 15))
    assert sorted(r.file_id for r in listed.collect()) == [11, 11]


def test_scan_stores_dimensions_and_tries_rejects_again(spark):
    listing = spark.createDataFrame([("q", "/a.jpg", 10, 1), ("q", "/b.jpg", 20, 1), ("q", "/c.jpg", 30, 1)], "session_id string, path string, size long, mtime_ns long")
    empty = lambda schema: spark.createDataFrame([], schema)
    sessions = snapshot.create_session(empty(schemas.SESSIONS), "q", "/lib", ScanConfig(), T0)
    before = scan.Tables(sessions, empty(schemas.FILES), empty(schemas.FINGERPRINTS), empty(schemas.GROUPS), empty(schemas.MEMBERS))
    asked = spark.sparkContext.accumulator(0)

    def prints(bad):
        def one(rows):
            for r in rows:
                asked.add(1)
                if r.path != bad:
                    yield (r.file_id, "h" + r.path, 1, 5, 640, 480)

        return lambda todo: spark.createDataFrame(todo.rdd.mapPartitions(one), "file_id long, content_hash string, dhash long, phash long, width int, height int").withColumn("exif", F.lit(None).cast(schemas.EXIF))

    first = scan.scan(before, listing, "q", ScanConfig(), prints("/c.jpg"), T0)
    assert asked.value == 3 and [r.path for r in first.rejects.collect()] == ["/c.jpg"]
    assert sorted((r.path, r.width, r.height) for r in first.files.collect()) == [("/a.jpg", 640, 480), ("/b.jpg", 640, 480)]
    assert first.groups.count() == 1 and first.members.count() == 2 and first.groups.first().kind == "visual"  # equal dimensions, other sizes
    tables = scan.Tables(first.sessions, first.files, first.fingerprints, first.groups, first.members)
    second = scan.scan(tables, listing.withColumn("mtime_ns", F.when(F.col("path") == "/a.jpg", 2).otherwise(1).cast("long")), "q", ScanConfig(), prints("/a.jpg"), T0)
    assert asked.value == 5 and [r.path for r in second.rejects.collect()] == ["/a.jpg"]
    assert {r.path: r.deleted_at for r in second.files.collect()} == {"/a.jpg": T0, "/b.jpg": None, "/c.jpg": None}
    assert second.members.count() == 2


def test_sessions_and_progress(spark):
    config = ScanConfig(phash_threshold=9, include_raw=True)
    sessions = snapshot.create_session(spark.createDataFrame([], schemas.SESSIONS), "q7", "/lib/winter/", config, T0)
    assert sessions.first().status == "scanning" and sessions.first().name == "winter"
    assert review.session_config(sessions, "q7")[0] == "/lib/winter/" and ScanConfig.from_json(review.session_config(sessions, "q7")[1]) == config
    sessions = snapshot.set_status(snapshot.bump_generation(sessions, "q7", T0), "q7", "paused", T0)
    assert sessions.first().scan_generation == 1 and sessions.first().status == "paused"
    metrics = spark.createDataFrame([("alps", "clustering", 511, 640, "/lib/y")], "session_id string, phase string, files_processed long, files_total_estimate long, last_path string")
    row = review.progress(metrics, library(spark)[1], "alps").first()
    assert (row.files_processed, row.files_total_estimate, row.groups) == (511, 640, 1)
    for call in (lambda: review.progress(metrics, library(spark)[1], "no"), lambda: review.session_config(sessions, "no")):
        with pytest.raises(review.NotFound):
            call()


def test_sessions_are_replaced_and_deleted_whole(spark, tmp_path):
    path = str(tmp_path / "groups")
    kind = "group_id long, session_id string"
    snapshot.write_partitions(spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d")], kind), path)
    snapshot.write_partitions(spark.createDataFrame([(4, "c")], kind), path, ["a b", "c"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(3, "d"), (4, "c")]
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "file_id long, session_id string")
    prints = spark.createDataFrame([(1,), (2,)], "file_id long")
    left = snapshot.delete_session({"files": rows, "fingerprints": prints}, "x")
    assert sorted(r.file_id for r in left["files"].collect()) == [2, 3] and [r.file_id for r in left["fingerprints"].collect()] == [2]
    files, groups, members = library(spark)
    groups, members = snapshot.clear_groups(groups, members, "alps")
    assert groups.count() == members.count() == 0


def test_shared_folder_must_be_named(spark, monkeypatch):
    from types import SimpleNamespace

    from nearfold.plans import storage

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(fake(master))
    assert storage.shared_dir(fake("local[2]")).startswith("file:///")
    with storage.scratch(spark) as kept:
        inner = storage.written(spark.range(3).toDF("id"), "inner")
        outer = kept(inner, "outer")
        where = storage.fresh_dir(spark, "x").rpartition("/")[0].removeprefix("file:")
        assert __import__("os").path.exists(where)
    assert outer.count() == 3 and not __import__("os").path.exists(where)


def test_snapshots(spark, tmp_path):
    files = spark.createDataFrame([(7, "s", "/a", 1, 1, 5, None, None, None, None, 1, None, None, None), (8, "s", "/b", 1, 1, 5, None, None, None, None, 1, None, None, None)], schemas.FILES.replace("file_id long, session_id string, path string, size long, mtime_ns long, width int, height int, inode long, scan_generation long, created_at timestamp, modified_at timestamp, deleted_at timestamp, ", "file_id long, session_id string, path string, size long, mtime_ns long, width int, height int, inode long, created_at timestamp, modified_at timestamp, scan_generation long, deleted_at timestamp, "))
    seen = spark.createDataFrame([("s", "/a", 2, 1), ("s", "/c", 3, 1)], "session_id string, path string, size long, mtime_ns long")
    asked = []
    updated, prints = snapshot.rescan(files, seen, lambda rows: asked.append(rows) or rows, 2, T0)
    by = {r.path: r for r in updated.collect()}
    assert (by["/a"].file_id, by["/a"].size, by["/a"].width, by["/a"].scan_generation) == (7, 2, None, 2)
    assert by["/b"].deleted_at == T0 and by["/c"].file_id > 0 and prints.count() == 2
    back = snapshot.upsert_files(updated, spark.createDataFrame([("s", "/b", 1, 1)], seen.schema), 3)
    assert back.where("path = '/b'").first().deleted_at is None
    old = spark.createDataFrame([(1, "x", None, 1), (2, "y", None, 2)], "file_id long, content_hash string, dhash long, phash long")
    new = spark.createDataFrame([(2, None, None, None)], old.schema)
    assert sorted((r.file_id, r.phash) for r in snapshot.upsert_fingerprints(old, new).collect()) == [(1, 1), (2, None)]
    path = str(tmp_path / "t")
    snapshot.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, session_id string"), path)
    snapshot.write_partitions(spark.createDataFrame([(3, "b")], "file_id long, session_id string"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_stream_stops_and_goes_on(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), "event_id long, event_type string", str(tmp_path / "out"), str(tmp_path / "state"), lambda b: b, files_per_batch=1)
    for expected in (3, 3, 4):
        run().awaitTermination()
        table = spark.read.parquet(str(tmp_path / "out"))
        assert table.select("batch").distinct().count() == expected
        if expected == 3:
            assert ingest.latest(table, ["event_id"]).count() == events.count()
        events.limit(2).withColumn("event_type", F.lit("late")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in")) if expected == 3 and table.count() == events.count() and not (tmp_path / "more").exists() and (tmp_path / "seen").exists() else None
        (tmp_path / "seen").touch()
    assert ingest.latest(spark.read.parquet(str(tmp_path / "out")), ["event_id"]).where("event_type = 'late'").count() == 2
    metrics = ingest.scan_metrics(table, table.limit(1), 10**9, 0.0).first()
    assert metrics.files_processed == table.count() and metrics.groups_found == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_works_without_the_text_subpackage(tmp_path):
    """The rest of the library, its entry and its tests in a copy without the two folders."""
    import pathlib
    import shutil
    import subprocess
    import sys

    import __spark_entry__

    root = pathlib.Path(__spark_entry__.__file__).parent
    for folder in ("nearfold", "tests"):
        shutil.copytree(root / folder, tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(root / name, tmp_path)
    env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [str(tmp_path), os.environ.get("PYTHONPATH", "")]))}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_groups' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests", "-k", "exact or path_parts or configs or entry"], cwd=tmp_path, check=True, env=env)


def test_small_chunks_share_partitions(spark, monkeypatch):
    """Chunks are ranges in order of bounded size, dealt to few partitions."""
    monkeypatch.setattr(cluster, "CHUNK", 1_000)
    rng = random.Random(4)
    times = sorted((rng.choice("ab"), us) for us in rng.sample(range(1 << 40), 5_000))
    chunks, parts = cluster._chunked(spark.createDataFrame(times, "session_id string, us long"), 10)
    found = sorted((r.session_id, r.us, r.chunk) for r in chunks.collect())
    numbers = [c for _, _, c in found]
    assert [r[:2] for r in found] == times and numbers == sorted(numbers) and parts == 500
    assert max(numbers.count(c) for c in set(numbers)) == 10 and len(set(numbers)) < 520 and len(chunks.inputFiles()) <= 5

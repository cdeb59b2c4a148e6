"""Duplicate groups in three tiers: identical content, near fingerprints, bursts.

Every function takes all sessions at once and works within each. A file is in one group at
most, a group is named by its smallest file_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from nearfold.functions import scalars as S
from nearfold.operators.components import connected_components
from nearfold.plans.config import ScanConfig
from nearfold.plans.storage import written

MEMBER = ["session_id", "kind", "confidence", "group_id", "file_id"]
BURST_CONFIDENCE = 0.75
CHUNK = 100_000
BLOCK_ROWS = 256
TILE_ROWS = 2_048
SLAB_ROWS = 256
KEY_ROWS = 8_192
LINK_TILE_ROWS = 16_384
LINK_SLAB_ROWS = 64
BUCKET_ROWS = 16_384
_CHUNKS_OF_PARTITION = 1 << 17


def exact_members(files: DataFrame) -> DataFrame:
    """Files of equal content_hash; a null hash equals nothing."""
    known = written(files.where("content_hash is not null").select("session_id", "content_hash", "file_id"), "hashes")
    groups = known.groupBy("session_id", "content_hash").agg(F.min("file_id").alias("group_id"), F.count("*").alias("n")).where("n >= 2")
    return (
        known.join(written(groups, "copies"), ["session_id", "content_hash"])  # written: a hot hash can be split in the join
        .withColumns({"kind": F.lit("exact"), "confidence": F.lit(1.0).cast("float")})
        .select(MEMBER)
    )


def _fingerprint_sets(files: DataFrame) -> DataFrame:
    """One row for equal (fingerprint, size, width, height): they are compatible and at distance 0."""
    same = ["session_id", "phash", "size", "width", "height"]
    return files.where("phash is not null").groupBy(*same).agg(F.min("file_id").alias("id"), F.count("*").alias("n"))


def set_members(files: DataFrame) -> DataFrame:
    """``(session_id, set_id, file_id)``: the files that stand as one in similar_pairs, under the smallest of their ids."""
    same = ["session_id", "phash", "size", "width", "height"]
    sets = _fingerprint_sets(files).select(F.col("id").alias("set_id"), *(F.col(c).alias(f"_{c}") for c in same))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    return files.where("phash is not null").join(sets, on).select("session_id", "set_id", "file_id")


def bands(count: int, low: int = 0, high: int = 64) -> list[int]:
    """``count`` masks over the bits from ``low`` to ``high``."""
    cuts = [low + (high - low) * i // count for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def all_bands(threshold: int) -> int:
    """The number of bands with which no pair within the threshold is left out."""
    return threshold + 1


def _signed(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _blocked(rows: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each mask, with the ``band`` (number of the mask) and the ``key`` (the bits under it)."""
    keys = F.array(*(F.struct(F.lit(i).alias("band"), F.col("phash").bitwiseAND(_signed(m)).alias("key")) for i, m in enumerate(masks)))
    return rows.withColumn("k", F.explode(keys)).withColumns({"band": F.col("k.band"), "key": F.col("k.key")}).drop("k")


def _first_band(masks: list[int]):
    """The first mask under which a and b agree: a pair that shares several blocks is given in that one only."""
    differ = F.col("a.phash").bitwiseXOR(F.col("b.phash"))
    return F.coalesce(*(F.when(differ.bitwiseAND(_signed(m)) == 0, F.lit(i)) for i, m in enumerate(masks)))


def _masks(threshold: int, band_count: int) -> list[int]:
    """The bits of which a pair must share one group: those of several bands, or the top 16 with one of threshold + 1 parts of the others."""
    if band_count > 1:
        return bands(band_count)
    top = bands(1, 48, 64)[0]
    return [top | m for m in bands(threshold + 1, 0, 48)] if threshold < 16 else [top]


def similar_pairs(files: DataFrame, threshold: int, band_count: int = 1) -> DataFrame:
    """``(session_id, a_id, b_id, distance)``, a_id < b_id: compatible rows that share a band and differ in ``threshold`` bits at most.

    With one band the top 16 bits must agree; the other 48 are cut into threshold + 1 parts, one of which agrees in every
    wanted pair, so blocks stay small. More than ``threshold`` bands find every pair within the threshold, by the same
    pigeonhole principle. Rows equal in all compared columns stand as one.

    Compatibility is part of the key, as in component_links; a pair of equal sizes is given by its size only. Blocks of up to BLOCK_ROWS rows are
    joined. Larger ones are dealt by hash to parts of about TILE_ROWS rows, and each pair of parts is a tile that is compared as a whole: no
    task holds more than two parts, and a hot block is many tasks. The pairs of all tiles are all pairs of the block.
    """
    masks = _masks(threshold, band_count)
    block = ["session_id", "kind", "k1", "k2", "band", "key"]
    rows = _kinds(_fingerprint_sets(files))
    dealt = written(_blocked(rows, masks).select(*block, "id", "phash", "other"), "dealt")
    sizes = dealt.groupBy(*block).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)
    hot = written(sizes.select(*block, F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("parts")), "hot")
    small = dealt.join(hot, block, "left_anti")
    distance = S.hamming(F.col("a.phash"), F.col("b.phash"))
    once = F.coalesce(F.col("a.other") != F.col("b.other"), F.lit(True)) & (F.col("a.band") == _first_band(masks))
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in block]
    pairs = small.alias("a").join(small.alias("b"), [*met, F.col("a.id") < F.col("b.id"), distance <= threshold, once])
    pairs = pairs.select("a.session_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), distance.alias("distance"))
    return pairs.unionByName(_tiles(dealt.join(hot, block), block, threshold, masks))


def _tiles(rows: DataFrame, block: list[str], threshold: int, masks: list[int]) -> DataFrame:
    """The pairs of similar_pairs of the large blocks ``rows``, each with the number of ``parts`` of its block."""
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"low": F.least("part", "with"), "high": F.greatest("part", "with")})
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("session_id", "id")}

    def compare(tile: pa.Table) -> pa.Table:
        low, high, band = (tile.column(c)[0].as_py() for c in ("low", "high", "band"))
        part, ids = tile.column("part").to_numpy(), tile.column("id").to_numpy()
        prints = tile.column("phash").to_numpy().view(np.uint64)
        known, other = tile.column("other").is_valid().to_numpy(), tile.column("other").fill_null(0).to_numpy()
        one, two = np.flatnonzero(part == low), np.flatnonzero(part == high)
        found = []
        for at in range(0, len(one), SLAB_ROWS):
            a, b = one[at : at + SLAB_ROWS], two[at:] if low == high else two
            d = np.bitwise_count(prints[a][:, None] ^ prints[b][None, :])
            i, j = np.nonzero(d <= threshold)
            i, j, d = a[i], b[j], d[i, j]
            differ = prints[i] ^ prints[j]
            good = ~(known[i] & known[j] & (other[i] == other[j]))
            if low == high:
                good &= i < j
            for m in masks[:band]:
                good &= differ & np.uint64(m) != 0
            found.append((ids[i[good]], ids[j[good]], d[good]))
        a, b, d = (np.concatenate(c) for c in zip(*found)) if found else (ids[:0], ids[:0], np.empty(0, np.uint8))
        session = pa.repeat(tile.column("session_id")[0], len(a))
        return pa.table({"session_id": session, "a_id": np.minimum(a, b), "b_id": np.maximum(a, b), "distance": d.astype(np.int32)})

    tiles = rows.select(*block, "low", "high", "part", "id", "phash", "other").groupBy(*block, "low", "high")
    return tiles.applyInArrow(compare, f"session_id {kinds['session_id']}, a_id {kinds['id']}, b_id {kinds['id']}, distance int")


def _kinds(sets: DataFrame, *more: str) -> DataFrame:
    """A row for each way in which a row can be compatible: by equal size (kind 1), or by equal width and height (kind 2; ``other`` is its size)."""
    size, none = F.col("size").cast("long"), F.lit(None).cast("long").alias("other")
    one = sets.select("session_id", F.lit(1).alias("kind"), size.alias("k1"), F.lit(0).cast("long").alias("k2"), "id", "phash", none, *more).where("k1 is not null")
    two = sets.select("session_id", F.lit(2).alias("kind"), F.col("width").cast("long").alias("k1"), F.col("height").cast("long").alias("k2"), "id", "phash", size.alias("other"), *more)
    return one.unionByName(two.where("k1 is not null and k2 is not null")).where("session_id is not null")


def _forest(prints: np.ndarray, kinds: np.ndarray, meets: list[list[int]], seeds: list[int], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that join all prints joined by distances up to ``threshold``, one fewer than the prints at most.

    A print of kind k is compared with those of the kinds ``meets[k]``, and each pair that counts has an end in ``seeds``. A search from each seed takes
    what it reaches out of the pools, so a dense part costs little more than its rows.
    """
    pools = [np.flatnonzero(kinds == k) for k in range(len(meets))]
    held = [prints[p] for p in pools]
    one, two = [pools[0][:0]], [pools[0][:0]]
    for kind in seeds:
        while len(pools[kind]) and any(len(pools[k]) for k in meets[kind]):
            fronts = [(kind, pools[kind][:1])]
            pools[kind], held[kind] = pools[kind][1:], held[kind][1:]
            while fronts:
                now, front = fronts.pop()
                for at in range(0, len(front), LINK_SLAB_ROWS):
                    slab = front[at : at + LINK_SLAB_ROWS]
                    for k in meets[now]:
                        near = np.bitwise_count(prints[slab][:, None] ^ held[k]) <= threshold
                        hit = near.any(axis=0)
                        reached = np.flatnonzero(hit)
                        if len(reached):
                            got = pools[k][reached]
                            one.append(got)
                            two.append(slab[near[:, reached].argmax(axis=0)])
                            pools[k], held[k] = pools[k][~hit], held[k][~hit]
                            fronts.append((k, got))
    return np.concatenate(one), np.concatenate(two)


def component_links(sets: DataFrame, threshold: int, band_count: int = 1) -> DataFrame:
    """``(a_id, b_id)``: links with the connected components of all pairs of similar_pairs, but not all the pairs.

    Where ``sets`` has a column ``asked``, the links of the other rows with one another are known and left out; rows that are joined already may have one id.

    Compatible rows share a size, or width and height, so each is a point of both kinds and compatibility is part of the key. Rows of one point
    (equal prints) are a star. The points of a key are compared as they are up to KEY_ROWS; those of a larger key are dealt to blocks by their bands, and
    blocks over LINK_TILE_ROWS to tiles of two parts. Every pair that shares a block meets in a tile, and a tile gives a spanning forest of its
    pairs: fewer links than rows, however many pairs there are. Small tiles share a task's group of about BUCKET_ROWS rows.
    """
    key = ["session_id", "kind", "k1", "k2"]
    block = [*key, "band", "key"]
    if "asked" not in sets.columns:
        sets = sets.withColumn("asked", F.lit(True))
    kind = sets.schema["id"].dataType.simpleString()
    rows = _kinds(sets, "asked").drop("other")
    points = rows.groupBy(*key, "phash").agg(F.min("id").alias("hub"), F.count("*").alias("n"), F.max("asked").alias("asked"))
    points = written(points, "points")
    hubs = points.where("n > 1 and asked").select(*key, "phash", "hub")
    stars = rows.join(hubs, [*key, "phash"]).select(F.col("id").alias("a_id"), F.col("hub").alias("b_id")).where("a_id <> b_id")

    masks = _masks(threshold, band_count)
    always = (1 << 64) - 1
    for m in masks:  # the bits that every mask has: the prefix with one band, none with several
        always &= m
    large = points.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > KEY_ROWS)
    large = written(large, "large-keys")
    points = points.drop("n")
    whole = points.join(large, key, "left_anti").withColumns({"band": F.lit(-1), "key": F.col("phash").bitwiseAND(_signed(always))})
    dealt = _blocked(points.join(large.select(key), key, "left_semi"), masks)
    every = whole.unionByName(dealt.select(whole.columns))
    n, few = points.agg(F.count("*"), F.count_if("asked")).first()
    if 16 * few < n:  # worth a search for the blocks that hold one
        asked = written(every.where("asked").select(*block).distinct(), "asked")
        every, dealt = (df.join(asked, block, "left_semi") for df in (every, dealt))
    hot = dealt.groupBy(*block).agg(F.count("*").alias("rows")).where(F.col("rows") > LINK_TILE_ROWS)
    hot = written(hot.withColumn("parts", F.ceil(F.col("rows") / LINK_TILE_ROWS).cast("int")), "hot")

    total = n + (len(masks) - 1) * (large.agg(F.sum("rows")).first()[0] or 0)
    total += hot.agg(F.sum(F.col("rows") * (F.col("parts") - 1))).first()[0] or 0
    parts = F.coalesce("parts", F.lit(1))
    tiles = every.join(hot.drop("rows"), block, "left").withColumn("part", F.pmod(F.xxhash64("hub", "phash"), parts).cast("int"))
    tiles = tiles.withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    tiles = tiles.withColumns({"low": F.least("part", "with"), "high": F.greatest("part", "with")})
    name = [*block, "low", "high"]  # 128 bits of it tell the tiles of a group apart
    tiles = tiles.select(
        F.pmod(F.xxhash64(*name), F.lit(max(1, -(-total // BUCKET_ROWS)))).cast("int").alias("bucket"), F.xxhash64(*name).alias("t1"), F.xxhash64(F.lit(1), *name).alias("t2"),
        (4 * (F.col("low") < F.col("high")).cast("int") + 2 * (F.col("part") > F.col("low")).cast("int") + F.col("asked").cast("int")).cast("byte").alias("flags"), "phash", F.col("hub").alias("id"),
    )

    def compare(bucket: pa.Table) -> pa.Table:
        t1, t2, flags, prints = (bucket.column(c).to_numpy() for c in ("t1", "t2", "flags", "phash"))
        order = np.lexsort((t2, t1))
        t1, t2, flags, prints = t1[order], t2[order], flags[order], prints[order].view(np.uint64)
        first = np.flatnonzero(np.append(True, (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])))
        size = np.diff(first, append=len(t1))
        one, two = [order[:0]], [order[:0]]
        for i, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
            held, kinds = prints[i : i + n], flags[i : i + n] & 3
            if n <= LINK_SLAB_ROWS and np.count_nonzero(np.bitwise_count(held[:, None] ^ held) <= threshold) == n:
                continue
            if flags[i] & 4:  # two parts: even and odd kinds are not asked and asked, 0 and 1 of the one part, 2 and 3 of the other
                a, b = _forest(held, kinds, [[3], [2, 3], [1], [0, 1]], [1, 3], threshold)
            else:
                a, b = _forest(held, kinds, [[1], [0, 1]], [1], threshold)
            one.append(order[i + a])
            two.append(order[i + b])
        ids = bucket.column("id")
        return pa.table({"a_id": ids.take(pa.array(np.concatenate(one))), "b_id": ids.take(pa.array(np.concatenate(two)))})

    links = tiles.groupBy("bucket").applyInArrow(compare, f"a_id {kind}, b_id {kind}")
    return stars.unionByName(links.where("a_id <> b_id"))


def group_confidences(parts: DataFrame, threshold: int) -> DataFrame:
    """``(group_id, confidence)`` of the groups of two files or more: 1 - least distance / threshold, over all pairs of files, linked or not.

    ``parts`` has group_id, phash and n (how many files stand for the row). A print that two files of a group share gives 0. Groups without one
    are searched for prints a bit apart, by flipping each bit, then by bands for wider radii, and leave the search with their first hit; what
    is as far apart as the threshold has confidence 0.
    """
    prints = written(parts.groupBy("group_id", "phash").agg(F.sum("n").alias("n")), "prints")
    groups = prints.groupBy("group_id").agg(F.sum("n").alias("members"), F.max("n").alias("most")).where("members >= 2")
    groups = written(groups, "groups")
    found = groups.where("most > 1").select("group_id", F.lit(0).alias("d"))
    left = prints.join(groups.where("most = 1").select("group_id"), "group_id", "left_semi").select("group_id", "phash")
    if threshold > 1:
        left = written(left, "single-prints")
        bits = F.array(*(_signed(1 << b) for b in range(64)))
        flipped = left.withColumn("bit", F.explode(bits)).select("group_id", F.col("phash").bitwiseXOR(F.col("bit")).alias("phash"))
        hits = written(flipped.join(left, ["group_id", "phash"], "left_semi").select("group_id", F.lit(1).alias("d")).distinct(), "one-bit")
        found = found.unionByName(hits)
        for radius in sorted({min(3, threshold - 1), threshold - 1} - {1}):
            left = left.join(hits, "group_id", "left_anti")
            inner = _blocked(left, bands(radius + 1))
            met = (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.phash") < F.col("b.phash"))
            closer = inner.alias("a").join(inner.alias("b"), met).select(F.col("a.group_id").alias("group_id"), S.hamming(F.col("a.phash"), F.col("b.phash")).alias("d"))
            hits = written(closer.where(F.col("d") <= radius).groupBy("group_id").agg(F.min("d").alias("d")), f"radius-{radius}")
            found = found.unionByName(hits)
    d = F.coalesce("d", F.lit(threshold))
    return groups.select("group_id").join(found, "group_id", "left").select("group_id", S.visual_confidence(d, threshold).alias("confidence"))


def visual_members(files: DataFrame, threshold: int = 6, band_count: int = 1) -> DataFrame:
    """Connected components of similar_pairs. Confidence: 1 - least distance / threshold over all pairs of the group.

    As there, one band joins only what has its top 16 bits in common; ``all_bands(threshold)`` gives every link within the threshold.
    """
    same = ["session_id", "phash", "size", "width", "height"]
    rows = files.where("phash is not null").select("file_id", *same, set_name().alias("set"))
    rows = written(rows, "prints-of-files")
    sets = written(rows.groupBy("set", *same).agg(F.min("file_id").alias("id"), F.count("*").alias("n")), "sets")
    parts = connected_components(component_links(sets, threshold, band_count), "a_id", "b_id")
    parts = sets.join(parts.select(F.col("node").alias("id"), F.col("component").alias("group_id")), "id", "left")
    parts = written(parts.select("set", "phash", "n", F.coalesce("group_id", "id").alias("group_id")), "parts")
    groups = written(group_confidences(parts.select("group_id", "phash", "n"), threshold), "confidences")
    near = written(parts.join(groups, "group_id").select("set", "group_id", "confidence"), "grouped")
    return rows.select("set", "session_id", "file_id").join(near, "set").withColumn("kind", F.lit("visual")).select(MEMBER)


def set_name():
    """The name of a set of equal rows: a digest of session, fingerprint, size, width and height, nulls told apart from texts."""
    same = ["session_id", "phash", "size", "width", "height"]
    return F.md5(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in same)))


def _islands(dated: DataFrame, window_us: int) -> DataFrame:
    """``dated`` with ``island``: the time of the first row after the last gap over the window, within its session.

    Rows are dealt by session and day; what a day needs of the days before it (their last time, the start of the island
    that runs into it) comes from a table with one row per session and day.
    """
    rows = dated.withColumn("day", F.floor(F.col("us") / F.lit(86_400_000_000)))
    by = Window.partitionBy("session_id", "day").orderBy("us", "file_id")
    rows = rows.withColumn("before", F.lag("us").over(by))
    days = rows.groupBy("session_id", "day").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max(F.when(F.col("us") - F.col("before") > window_us, F.col("us"))).alias("cut")
    )
    over = Window.partitionBy("session_id").orderBy("day")  # a row per day
    days = days.withColumn("before_us", F.lag("last_us").over(over))
    opens = F.col("before_us").isNull() | (F.col("first_us") - F.col("before_us") > window_us)
    days = days.withColumn("opened", F.when(opens, F.col("first_us")))
    days = days.withColumn("newest", F.coalesce("cut", "opened"))
    carried = F.last("newest", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("session_id", "day", F.coalesce("opened", carried).alias("start"))
    marked = rows.join(days, ["session_id", "day"])
    cut = F.when(F.col("us") - F.col("before") > window_us, F.col("us"))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("island", F.coalesce(F.last(cut, ignorenulls=True).over(upto), "start")).drop("day", "before", "start")


def _chunked(times: DataFrame, size: int | None = None) -> tuple[DataFrame, int]:
    """``times`` with ``chunk``: ranges of (session, time) of ``size`` (CHUNK) rows at most, in order, written; and about how many chunks there are.

    A partition holds about CHUNK rows, however small its chunks are: as many tasks as chunks would cost far more than the rows in them.
    """
    size, n = size or CHUNK, times.count()
    dealt = times.repartitionByRange(max(1, -(-n // max(size, CHUNK))), "session_id", "us").sortWithinPartitions("session_id", "us")
    row = F.monotonically_increasing_id()  # the number of the partition above 33 bits with the place in it
    places = dealt.withColumn("row", row).withColumn("at", F.col("row").bitwiseAND(F.lit((1 << 33) - 1)))
    chunk = F.shiftright("row", 33) * F.lit(_CHUNKS_OF_PARTITION) + F.floor(F.col("at") / F.lit(size))
    return written(places.withColumn("chunk", chunk.cast("int")).drop("row", "at"), "chunks"), max(1, -(-n // size))


def _after(us: np.ndarray, window_us: int) -> np.ndarray:
    """For each time, in order, the place of the first one more than the window later; the number of times if there is none."""
    return np.searchsorted(us, us + window_us, "right")


def _last_anchors(us: np.ndarray, window_us: int) -> np.ndarray:
    """For each time, were it an anchor, the place of the last anchor that then follows in the chunk: all jumps at once, doubled until they end."""
    jump = _after(us, window_us)
    jump = np.where(jump < len(us), jump, np.arange(len(us)))
    while True:
        twice = jump[jump]
        if (twice == jump).all():
            return jump
        jump = twice


def _entries(chunks: DataFrame, bounds: DataFrame, window_us: int) -> DataFrame:
    """``(session_id, chunk, entry_us, carry_us)`` of the chunks of ``bounds``: the first anchor in the chunk, if any, and the last one before it.

    A chunk turns any anchor that enters it into the last anchor in it, and that one enters a later chunk. These transitions, of the
    few anchors that can be the last of a chunk, are followed from the first time of each session by doubling: in round i the
    reached ones are joined with their 2^i-th successors. ``bounds`` has the sessions of several chunks, two rows per chunk at most.
    """
    kind = chunks.schema["session_id"].dataType.simpleString()
    ends = {}
    for r in bounds.orderBy("session_id", "chunk").collect():  # at most two rows per chunk, whatever the number of sessions
        ends.setdefault(r.session_id, []).append((r.last_us, r.chunk))
    ends = {session: tuple(np.array(c, np.int64) for c in zip(*held)) for session, held in ends.items()}  # once, not in every chunk
    begin = -(1 << 62)

    def exits(frame: pd.DataFrame) -> pd.DataFrame:
        session, us = frame["session_id"].iloc[0], np.sort(frame["us"].to_numpy())
        last = us[np.unique(_last_anchors(us, window_us))]
        upto, number = ends[session]
        if number[0] == frame["chunk"].iloc[0]:  # the start, which is before everything, enters the first chunk
            last = np.append(last, begin)
        at = np.searchsorted(upto, np.where(last == begin, begin, last + window_us), "right")
        last, at = last[at < len(upto)], at[at < len(upto)]
        return pd.DataFrame({"session_id": session, "a": last, "chunk": number[at]})

    def transitions(frame: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        us, a = np.sort(frame["us"].to_numpy()), asked["a"].to_numpy()
        entry = np.searchsorted(us, np.where(a == begin, begin, a + window_us), "right")
        return pd.DataFrame({"session_id": asked["session_id"], "chunk": asked["chunk"], "a": a, "entry_us": us[entry], "b": us[_last_anchors(us, window_us)[entry]]})

    several = written(chunks.join(bounds.select("session_id", "chunk"), ["session_id", "chunk"], "left_semi").select("session_id", "chunk", "us"), "several")
    leaving = several.groupBy("session_id", "chunk").applyInPandas(exits, f"session_id {kind}, a long, chunk int")
    edges = several.groupBy("session_id", "chunk").cogroup(written(leaving, "exits").groupBy("session_id", "chunk"))
    edges = edges.applyInPandas(transitions, f"session_id {kind}, chunk int, a long, entry_us long, b long")
    edges = written(edges, "transitions")
    reached, jump = edges.where(F.col("a") == begin).select("session_id", "a"), edges.select("session_id", "a", "b")
    while not jump.isEmpty():
        on = reached.join(jump, ["session_id", "a"]).select("session_id", F.col("b").alias("a"))
        reached = written(reached.unionByName(on).distinct(), "reached")
        ahead = jump.select("session_id", F.col("a").alias("b"), F.col("b").alias("c"))
        jump = written(jump.join(ahead, ["session_id", "b"]).select("session_id", "a", F.col("c").alias("b")), "jump")
    visited = edges.join(reached, ["session_id", "a"]).select("session_id", "chunk", "entry_us", "b")
    over = Window.partitionBy("session_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    found = bounds.join(visited, ["session_id", "chunk"], "left").withColumn("carry_us", F.last("b", ignorenulls=True).over(over))
    return found.select("session_id", "chunk", "entry_us", "carry_us")


def anchored(rows: DataFrame, window_us: int, chunk: int | None = None) -> DataFrame:
    """``(session_id, us, anchor_id, anchor_camera)`` for every distinct time of ``rows`` (session_id, file_id, us, camera): the anchor that consumes it.

    Rows of one time have one anchor, so times are folded, not rows. They are cut into chunks of bounded size, also within
    a session; ``_entries`` says where the anchors enter a chunk, and each chunk is folded by itself.
    """
    kind = rows.schema["session_id"].dataType.simpleString()
    times = rows.groupBy("session_id", "us").agg(F.min(F.struct("file_id", "camera")).alias("first"))
    chunks, parts = _chunked(written(times.select("session_id", "us", "first.file_id", "first.camera"), "times"), chunk)
    chunks = chunks.withColumn("_null", F.lit(None).cast("long"))
    if parts > 1:
        bounds = chunks.groupBy("session_id", "chunk").agg(F.max("us").alias("last_us"))
        many = bounds.groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1").select("session_id")
        info = written(_entries(chunks, written(bounds.join(many, "session_id"), "bounds"), window_us), "entries")
        carry = chunks.select("session_id", F.col("us").alias("carry_us"), F.col("file_id").alias("carry_id"), F.col("camera").alias("carry_camera"))
        info = info.join(carry, ["session_id", "carry_us"], "left").withColumn("inner", F.lit(True))
        chunks = chunks.join(info, ["session_id", "chunk"], "left")
    else:
        chunks = chunks.withColumns({"entry_us": F.col("_null"), "carry_us": F.col("_null"), "carry_id": F.col("_null"), "carry_camera": F.lit(None).cast("string"), "inner": F.lit(None).cast("boolean")})

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("us")
        us, one = frame["us"].to_numpy(), frame.iloc[0]
        ids, cameras = frame["file_id"].to_numpy(), frame["camera"].to_numpy(object)
        whole = pd.isna(one["inner"])  # the only chunk of its session
        i = 0 if whole else len(us) if pd.isna(one["entry_us"]) else int(np.searchsorted(us, int(one["entry_us"])))
        jump, anchors = _after(us, window_us).tolist(), []
        while i < len(us):
            anchors.append(i)
            i = jump[i]
        at = np.searchsorted(np.array(anchors, np.int64), np.arange(len(us)), "right") - 1
        of = np.array([*anchors, 0])[at]  # -1: before the first anchor here
        anchor_id, anchor_camera = ids[of], cameras[of]
        if (at < 0).any():
            anchor_id = np.where(at < 0, int(one["carry_id"]), anchor_id)
            anchor_camera[at < 0] = one["carry_camera"]
        return pd.DataFrame({"session_id": frame["session_id"], "us": us, "anchor_id": anchor_id, "anchor_camera": anchor_camera})

    return chunks.drop("_null").groupBy("session_id", "chunk").applyInPandas(fold, f"session_id {kind}, us long, anchor_id long, anchor_camera string")


def burst_rows(rows: DataFrame, window_us: int, chunk: int | None = None) -> DataFrame:
    """Burst members of ``rows`` (session_id, file_id, us, camera); ``chunk`` is the number of times that are folded together."""
    rows = written(rows, "dated")
    of = written(anchored(rows, window_us, chunk), "anchored")
    shots = rows.join(of.hint("merge"), ["session_id", "us"]).where("camera = anchor_camera").select("session_id", F.col("anchor_id").alias("anchor"), "file_id")
    shots = written(shots, "shots")
    groups = shots.groupBy("session_id", "anchor").agg(F.min("file_id").alias("group_id"), F.count("*").alias("n")).where("n >= 2")
    return (
        shots.join(written(groups, "bursts"), ["session_id", "anchor"])
        .withColumns({"kind": F.lit("burst"), "confidence": F.lit(BURST_CONFIDENCE).cast("float")})
        .select(MEMBER)
    )


def dated_rows(files: DataFrame, camera: str = "camera") -> DataFrame:
    """What the burst tier looks at: (session_id, file_id, us, camera) of the files with a date."""
    us = F.unix_micros(F.col("date_taken").cast("timestamp"))
    return files.where("date_taken is not null").select("session_id", "file_id", us.alias("us"), F.coalesce(F.col(camera), F.lit("|")).alias("camera"))


def burst_members(files: DataFrame, window_secs: int, camera: str = "camera", chunk: int | None = None) -> DataFrame:
    """Groups of one camera in anchor windows.

    In time order (ties by file_id) the first row not yet consumed is the anchor. Rows up to and including the window
    after it are consumed; those of its camera are its group, the others are in none. Rows without a date take no
    part. ``files`` has session_id, file_id, date_taken and the camera column.
    """
    return burst_rows(dated_rows(files, camera), window_secs * 1_000_000, chunk)


def without(files: DataFrame, used: DataFrame) -> DataFrame:
    """Files that no earlier tier has taken."""
    return files.join(used.select("session_id", "file_id"), ["session_id", "file_id"], "left_anti")


def tiered_members(
    files: DataFrame, config: ScanConfig, burst_window_secs: int | None = None, camera: str = "camera", band_count: int | None = None
) -> DataFrame:
    """The members of all groups; each tier sees only what the tiers before it left. Every link within the threshold counts, unless ``band_count`` says otherwise."""
    band_count = band_count or all_bands(config.phash_threshold)
    tiers, left = [], files
    runs = [
        (config.exact_hash, exact_members),
        (config.visual_similar, lambda f: visual_members(f, config.phash_threshold, band_count)),
        (config.burst_detection, lambda f: burst_members(f, burst_window_secs or config.burst_window_secs, camera)),
    ]
    for wanted, tier in runs:
        if wanted:
            found = written(tier(left), "tier")
            tiers.append(found)
            left = without(left, found)
    if not tiers:
        return files.sparkSession.createDataFrame([], "session_id string, kind string, confidence float, group_id long, file_id long")
    found = tiers[0]
    for t in tiers[1:]:
        found = found.unionByName(t)
    return found

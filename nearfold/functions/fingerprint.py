"""Fingerprints: of text, of rasters held in arrays, and of images."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


BYTES_AT_ONCE = 1 << 22
WORDS_AT_ONCE = 1 << 17
WORDS_KEPT = 250_000
LANE = 255


def _word_bits(words: list[str], known: dict[str, bytes]) -> np.ndarray:
    """The first 64 bits of the MD5 of each word, a byte for each bit; eight of the bytes at a time as one long."""
    if len(known) >= WORDS_KEPT:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = hashlib.md5(w.encode()).digest()[7::-1]
    found = np.frombuffer(b"".join([known[w] for w in words]), np.uint8).reshape(-1, 8)
    return np.unpackbits(found, axis=1, bitorder="little").view(np.uint64)


def _simhash(texts: pa.Array, known: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows with words, their SimHash). Each distinct word is hashed once; the bits of up to LANE words of a row
    are added eight counters to a long, then these sums row by row."""
    parts = pc.split_pattern(texts.fill_null(""), pattern=" ")
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes, rows = coded.indices.to_numpy(), np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    if "" in words:
        full = codes != words.index("")
        codes, rows = codes[full], rows[full]
    count = np.bincount(rows, minlength=len(texts))
    bits, sums = _word_bits(words, known), np.zeros((len(texts), 64), np.int64)
    for i in range(0, len(codes), WORDS_AT_ONCE):
        row = rows[i : i + WORDS_AT_ONCE]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        nth = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
        cut = np.flatnonzero(nth % LANE == 0)
        lanes = np.add.reduceat(bits[codes[i : i + WORDS_AT_ONCE]], cut, axis=0).view(np.uint8)
        sums[row[first]] += np.add.reduceat(lanes, np.searchsorted(cut, first), axis=0, dtype=np.int64)
    some = np.flatnonzero(count)
    return some, np.packbits(2 * sums[some] > count[some, None], axis=1, bitorder="little").view(np.int64)[:, 0]


def _simhash_batches(batches, id_col: str):
    """The ids and SimHashes of each Arrow batch of ids and texts; one record batch out for each in. Memory beside the batch is bounded, and what
    a part has freed goes back to the system, as workers live on and several share an executor."""
    known: dict[str, bytes] = {}
    for batch in batches:
        texts, rows, prints = batch.column(1), [], []
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < len(texts):
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right")))
            some, found = _simhash(texts.slice(i, j - i), known)
            rows.append(some + i)
            prints.append(found)
            i = j
        rows, prints = (np.concatenate([np.empty(0, np.int64), *parts]) for parts in (rows, prints))
        yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(prints, pa.int64())], [id_col, "phash"])
        del batch, texts
        pa.default_memory_pool().release_unused()


def text_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, phash)`` by SimHash (Charikar, 2002) over the space-separated words of a lower-case text.

    Bit b is set if more than half of the words, repeats counted, have it set. The value depends on one row only, so
    rows are taken in Arrow batches and nothing is shuffled; a batch is worked through in parts of BYTES_AT_ONCE bytes, or of
    one longer text, and WORDS_AT_ONCE words at most are spread to bits at a time. A document without words has no row. Null texts are without words.
    """

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.lower(F.col(text_col))).mapInArrow(lambda batches: _simhash_batches(batches, id_col), f"`{id_col}` {kind}, phash long")


def pack_bits(bits: list[Column]) -> Column:
    """A long whose bit i is the i-th condition."""
    found = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        found = found.bitwiseOR(F.when(b, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return found


def gradient_hash(raster: Column, width: int = 8, height: int = 8) -> Column:
    """Bit per horizontal neighbours, row by row: left < right. ``raster`` holds width * height values."""
    cells = [(y * width + x, y * width + x + 1) for y in range(height) for x in range(width - 1)]
    return pack_bits([F.get(raster, a) < F.get(raster, b) for a, b in cells])


def median_hash(raster: Column, size: int = 64) -> Column:
    """Bit per value: above the mean of the two middle values."""
    half = lambda ordered: (F.get(ordered, size // 2 - 1).cast("double") + F.get(ordered, size // 2).cast("double")) / 2
    bits = lambda middle: pack_bits([F.get(raster, i).cast("double") > middle for i in range(size)])
    return _bound(_bound(F.array_sort(raster), half), bits)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def dct_hash(raster: Column, side: int = 8) -> Column:
    """``median_hash`` of the two-dimensional cosine transform (type II, unscaled) of a side * side raster."""
    basis = [[math.cos(math.pi * (2 * x + 1) * u / (2 * side)) for x in range(side)] for u in range(side)]
    table = F.array(*(F.array(*map(F.lit, row)) for row in basis))
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    places = F.sequence(F.lit(0), F.lit(side - 1))

    def both_ways(values: Column, table: Column) -> Column:
        lines = F.transform(places, lambda y: F.slice(values, y * side + 1, side))
        rows = F.transform(lines, lambda line: F.transform(table, lambda b: total(F.zip_with(b, line, lambda c, v: c * v))))
        down = lambda rows: F.transform(
            table, lambda b: F.transform(places, lambda u: total(F.zip_with(b, rows, lambda c, line: c * F.get(line, u))))
        )
        return F.flatten(_bound(rows, down))

    doubles = F.transform(raster, lambda v: v.cast("double"))
    waves = _bound(table, lambda t: _bound(doubles, lambda v: both_ways(v, t)))
    return _bound(waves, lambda w: median_hash(w, side * side))


def plain_path(origin: Column) -> Column:
    """The path of an image as file listings spell it: one slash after the scheme of a local file."""
    return F.regexp_replace(origin, "^file:///", "file:/")


TILE_BYTES = 1 << 20
GREY = np.array([114.0, 587.0, 299.0])  # thousandths of blue, green and red


def image_tiles(images: DataFrame, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``(path, width, height, channels, tiles, tile, y, x, data)``: the decoded pixels of Spark's image source in pieces.

    A tile is as many whole pixel rows as ``tile_bytes`` holds or, of wider rows, a part of one: ``data`` begins at pixel (y, x).
    The tiles of an image follow one another in one partition, numbered from 0. An image that did not decode has one row with nulls.
    """
    width, height, channels = (F.col(f"image.{c}") for c in ("width", "height", "nChannels"))
    sizes = images.select(
        plain_path(F.col("image.origin")).alias("path"), F.when(width > 0, width).alias("width"), F.when(width > 0, height).alias("height"),
        channels.alias("channels"), F.col("image.data").alias("data"),
    )
    whole = lambda a, b: F.floor(a / b).cast("int")
    pixels = F.greatest(F.lit(1), whole(F.lit(tile_bytes), F.col("channels")))
    shaped = sizes.withColumn("_pixels", pixels).withColumn("_rows", F.greatest(F.lit(1), whole(pixels, F.col("width"))))
    shaped = shaped.withColumn("_parts", F.ceil(F.col("width") / F.col("_pixels")).cast("int"))
    shaped = shaped.withColumn("tiles", (F.ceil(F.col("height") / F.col("_rows")) * F.col("_parts")).cast("int"))

    def cut(data: Column, t: Column) -> Column:
        y, x = whole(t, F.col("_parts")) * F.col("_rows"), t % F.col("_parts") * F.col("_pixels")
        rows = F.least(F.col("_rows"), F.col("height") - y)
        columns = F.least(F.col("_pixels"), F.col("width") - x)
        at = (y * F.col("width") + x) * F.col("channels")
        return F.struct(t.alias("tile"), y.alias("y"), x.alias("x"), F.substring(data, at + 1, rows * columns * F.col("channels")).alias("data"))

    numbers = F.sequence(F.lit(0), F.col("tiles") - 1)
    parts = _bound(F.col("data"), lambda data: F.transform(numbers, lambda t: cut(data, t)))  # the pixels are bound once, not read for each tile
    each = shaped.select("path", "width", "height", "channels", "tiles", F.explode_outer(parts).alias("part"))
    return each.select("path", "width", "height", "channels", "tiles", "part.*")


def _overlap(first: int, n: int, size: int, cells: int) -> np.ndarray:
    """How much of the pixels first, first + 1, ... of ``size`` lies in each of ``cells`` equal cells, in 1 / cells of a pixel: whole numbers."""
    begin = (first + np.arange(n, dtype=np.int64)) * cells
    edge = np.arange(cells + 1, dtype=np.int64)[:, None] * size
    return np.maximum(0, np.minimum(begin + cells, edge[1:]) - np.maximum(begin, edge[:-1])).astype(float)


def image_hashes(images: DataFrame, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``(path, width, height, dhash, phash)`` from Spark's image source; images that do not decode have null values.

    Grey levels are averaged over the cells of a 9 x 8 grid for the gradient hash and of an 8 x 8 grid,
    through the cosine transform, for the median hash. A worker holds one Arrow batch of tiles (a bound in bytes of the session)
    and, of the image they belong to, two grids of sums. The sums are whole numbers, so the hashes do not depend on the tiles.
    """

    def packed(bits: np.ndarray) -> int:
        value = sum(1 << i for i, b in enumerate(bits.ravel().tolist()) if b)
        return value - (1 << 64) if value >> 63 else value

    basis = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(8) + 1) / 16)
    schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("dhash", pa.int64()), ("phash", pa.int64())])

    def run(batches):
        wide, square = np.zeros((8, 9), np.int64), np.zeros((8, 8), np.int64)
        for batch in batches:
            out, data = [], batch.column(8)
            for i, (path, w, h, channels, tiles, tile, y, x) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(8)))):
                if tile is None:
                    out.append({"path": path})
                    continue
                if tile == 0:
                    wide[:], square[:] = 0, 0
                pixels = np.frombuffer(data[i].as_buffer(), np.uint8).reshape(-1, channels)
                grey = pixels[:, :3].astype(float) @ GREY if channels >= 3 else pixels[:, 0] * 1000.0
                grey = grey.reshape(-1, min(w, len(grey)))
                rows, columns = grey.shape
                down = _overlap(y, rows, h, 8) @ grey
                for total, cells in ((wide, 9), (square, 8)):
                    total += (down @ _overlap(x, columns, w, cells).T).astype(np.int64)
                if tile == tiles - 1:
                    waves = basis @ (square / (1000.0 * w * h)) @ basis.T
                    out.append({"path": path, "width": w, "height": h, "dhash": packed(wide[:, :-1] < wide[:, 1:]), "phash": packed(waves > np.median(waves))})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return image_tiles(images, tile_bytes).mapInArrow(run, "path string, width int, height int, dhash long, phash long")

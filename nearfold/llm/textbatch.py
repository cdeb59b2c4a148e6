"""Words, lines and their 64-bit hashes of whole Arrow batches, without a Python loop over characters.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so they may be
found in the UTF-8 bytes themselves. A null text is an empty text here.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PIECE_BYTES = 1 << 18
FILTER_BITS = 1 << 25
LONG_SPAN = 256
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on an array of unsigned 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=_U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 22:
            _powers[name] = have
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of one row if it alone is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 places where each row's words begin."""
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes give equal hashes wherever they stand.

    Sums of this form can be made to collide in runs of a thousand bytes or so, so spans of more than LONG_SPAN bytes are hashed by BLAKE2.
    """
    n = len(data)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=total[1:])
    found = (total[ends] - total[starts]) * _power("down", _BASE_INV, n + 1)[starts]
    found = mix(found + (ends - starts).astype(_U))
    for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        found[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return found


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words in one row; of the whole row if it has fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    found = np.full(n - width + 1, width, dtype=_U)
    for j in range(width):
        found = mix(found + words[j : n - width + 1 + j])
    return found


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Start and end byte of every \n-split line (the break left out) and where each row's lines begin."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    counts = np.bincount(row, minlength=len(offsets) - 1) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(counts)])


def filter_bits(rows: DataFrame, column: str) -> np.ndarray:
    """A bit filter of FILTER_BITS bits over the longs of a column, whatever their number: it only saves work, a join follows it."""
    slot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = (
        rows.select(F.shiftright(slot, 5).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 32L) as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    found = np.zeros(FILTER_BITS // 32, np.uint32)
    table = words.toArrow()  # at most FILTER_BITS / 32 rows
    found[table.column("w").to_numpy()] = table.column("b").to_numpy().astype(np.uint32)
    return found


def passing(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the longs may be among those of the filter."""
    slot = values & (FILTER_BITS - 1)
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32) & 1).astype(bool)

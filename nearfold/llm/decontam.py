"""Benchmark decontamination: passages within a small edit distance of a benchmark item.

The CGK embedding (Chakraborty, Goldenberg, Koucky, 2016) walks over a sequence of words:
at each step it writes the word it stands on and moves on by a random bit that depends
on the step and the word. Sequences at edit distance K get walks at Hamming distance
O(K * K) with constant probability. Each repetition draws new bits and samples SAMPLES
steps; a window and an item that agree on all of them are a candidate, and every
candidate is verified by edit distance.

A window starts at every word and has an item's size. Items are taken in classes by size and only
steps below the smallest size of the class are sampled, so a walk never leaves a window of
that class and one walk serves all the sizes in it. The first sampled step is one of FIRST in turn, and at most a
fifth of the smallest size, so that no early word decides; it is common to the larger
classes, and a walk ends as soon as no item has the words sampled so far: most windows
end at their first sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfold.llm.textbatch import LOWER, hashes, mix, pieces, spans, utf8

_U = np.uint64
ITEM_BLOCK = 20_000
CLASS_SIZES = (1, 2, 4, 8, 14, 20, 28, 40, 60)
COMMON = 14
FIRST = (0, 1, 2, 4, 6, 8)
MATCHES = "doc_id long, item_id long, start_word long, end_word long, distance int"


@dataclass(frozen=True)
class Search:
    """``edits``: words that may differ, as a share of the item. ``repetitions``: chosen for a recall of 0.95 or more with
    a tenth of the words edited, for 20 to 200 words (tests/llm measures it; texts that agree exactly are always found)."""

    edits: float = 0.1
    repetitions: int = 30
    samples: int = 6
    seed: int = 20


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column (A-Z as a-z) and where each row's begin."""
    data, offsets = utf8(column)
    found, rows = [], [0]
    for i, j in pieces(offsets):
        some = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, at = spans(some, offsets[i : j + 1] - offsets[i])
        found.append(hashes(some, starts, ends))
        rows += (rows[-1] + at[1:]).tolist()
    return (np.concatenate(found) if found else np.zeros(0, _U)), np.array(rows, np.int64)


def _steps(rng: np.random.Generator, first: int, low: int, samples: int) -> list[int]:
    """Sampled steps for items of ``low`` words or more: ascending, all below ``low``, mostly two or more apart."""
    rest = np.arange(first + 2, low, 1 if low < COMMON else 2) + (int(rng.integers(2)) if low >= COMMON else 0)
    rest = rest[rest < low]
    return [first, *sorted(rng.choice(rest, min(samples - 1, len(rest)), replace=False).tolist())]


def _move(flat: np.ndarray, place: np.ndarray, turn: np.uint64) -> np.ndarray:
    return (flat[place] * turn).view(np.int64) < 0  # the top bit


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return (key & _U((1 << bits) - 1)).astype(np.int64)


class Tables:
    """The sampled walks of all items: for each repetition and class of sizes the steps, a bit filter after each step, and the keys."""

    def __init__(self, words: list[np.ndarray], search: Search):
        self.words, self.search = words, search
        size = np.array([len(w) for w in words], np.int64)
        self.bits = max(16, int(np.ceil(np.log2(max(len(words), 1)))) + 4)
        flat = np.concatenate([*words, np.zeros(64, _U)])
        at = np.cumsum([0, *size[:-1]]) if len(words) else np.zeros(0, np.int64)
        self.plans: list[list[tuple]] = []
        for r in range(search.repetitions):
            turns, first, plans = self._turns(r), FIRST[r % len(FIRST)], []
            for c, low in enumerate(CLASS_SIZES):
                high = CLASS_SIZES[c + 1] if c + 1 < len(CLASS_SIZES) else 1 << 60
                mine = np.flatnonzero((size >= low) & (size < high))
                if not len(mine):
                    continue
                rng = np.random.default_rng([search.seed, r, c])
                steps = _steps(rng, min(first, low // 5), low, search.samples)
                place, key, step, filters = at[mine].copy(), np.zeros(len(mine), _U), 0, []
                for s in steps:
                    while step < s:
                        place += _move(flat, place, turns[step])
                        step += 1
                    key = flat[place] if not filters else mix(key ^ flat[place])
                    seen = np.zeros(1 << self.bits, bool)
                    seen[_slots(key, self.bits)] = True
                    filters.append(seen)
                order = np.argsort(key, kind="stable")
                plans.append((steps, filters, key[order], mine[order]))
            self.plans.append(plans)

    def _turns(self, r: int) -> np.ndarray:
        """One odd multiplier for each step; the top bit of its product with a word's hash moves the walk on."""
        return np.random.default_rng([self.search.seed, r]).integers(0, 1 << 63, 64, np.uint64) * _U(2) + _U(1)

    def _starts(self, n: int, slots: np.ndarray, moves: list[np.ndarray], begin: int, seen: np.ndarray) -> np.ndarray:
        """The windows whose walk stands on a word of ``seen`` at the step ``begin``.

        Found for all places at once, from the last step back: a walk that stands on a place at some step ends well if it
        does from where it moves to. These are operations on whole arrays of booleans, without a lookup by place.
        """
        good = seen[slots]
        for step in range(begin - 1, -1, -1):
            stay = good[:-1]
            good = stay ^ ((stay ^ good[1:]) & moves[step][: len(stay)])
        return np.flatnonzero(good[:n])

    def candidates(self, flat: np.ndarray, n: int) -> np.ndarray:
        """(window start, item) of every window that agrees with an item; ``flat`` has n words, then 64 zeros."""
        found, slots = [], _slots(flat, self.bits)
        for r, plans in enumerate(self.plans):
            turns = self._turns(r)
            begins = sorted({p[0][0] for p in plans})
            moves = [(flat * t).view(np.int64) < 0 for t in turns[: max(begins, default=0)]]
            for begin in begins:
                group = [p for p in plans if p[0][0] == begin]
                start = self._starts(n, slots, moves, begin, np.logical_or.reduce([p[1][0] for p in group]))
                place = start
                for step in range(begin):
                    place = place + moves[step][place]
                state = (start, place, flat[place], begin)
                for steps, filters, keys, items in group:
                    own = state
                    for s, seen in zip(steps[1:], filters[1:]):
                        own = _advance(flat, turns, own, s, seen, self.bits)
                    low, high = np.searchsorted(keys, own[2]), np.searchsorted(keys, own[2], "right")
                    many = high - low
                    if many.any():
                        where = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
                        found.append(np.stack([np.repeat(own[0], many), items[where]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _advance(flat, turns, state, to: int, seen, bits: int):
    """Walks to the step ``to``, takes the word there into the key and keeps the walks that an item shares."""
    start, place, key, step = state
    while step < to:
        place = place + _move(flat, place, turns[step])
        step += 1
    key = mix(key ^ flat[place])
    some = np.flatnonzero(seen[_slots(key, bits)])
    return start[some], place[some], key[some], step


def best_match(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the run of ``text`` nearest to ``item`` by edit distance in words; the first of equals."""
    n = len(text)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, w in enumerate(item.tolist(), 1):
        step = np.empty(n + 1, np.int64)
        step[0] = i
        swap = cost[:-1] + (text != w)
        drop = cost[1:] + 1
        step[1:] = np.minimum(swap, drop)
        source = np.concatenate([[0], np.where(swap <= drop, origin[:-1], origin[1:])])
        lead = step - ramp
        least = np.minimum.accumulate(lead)
        where = np.maximum.accumulate(np.where(lead == least, ramp, 0))
        cost, origin = least + ramp, source[where]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


def _search_block(docs: DataFrame, items: list[tuple[int, str]], search: Search) -> DataFrame:
    ids = [i for i, _ in items]
    flat, rows = _words(pa.array([t for _, t in items], pa.string()))
    words = [flat[a:b] for a, b in zip(rows[:-1], rows[1:])]
    some = [k for k, w in enumerate(words) if len(w)]
    ids, words = [ids[k] for k in some], [words[k] for k in some]
    tables = docs.sparkSession.sparkContext.broadcast((ids, words))  # ITEM_BLOCK items at most
    made: list[Tables] = []

    def run(batches):
        names, words_ = tables.value
        if not made:
            made.append(Tables(words_, search))
        for batch in batches:
            text, at = _words(batch.column(1))
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            row_of = np.arange(len(at) - 1)
            for i, j in pieces(at, 1 << 17):
                part = text[at[i] : at[j]]
                padded = np.concatenate([part, np.zeros(64, _U)])
                hits = made[0].candidates(padded, len(part))
                owner = row_of[np.searchsorted(at, at[i] + hits[:, 0], "right") - 1]
                for (start, item), row in zip(hits.tolist(), owner.tolist()):
                    target = words_[item]
                    allowed = int(search.edits * len(target))
                    a, b = int(at[row] - at[i]), int(at[row + 1] - at[i])
                    if np.array_equal(part[start : min(b, start + len(target))], target):
                        best = (0, start - a, start - a + len(target))
                    elif not allowed or found.get((row, item), (1, 0, 0))[0] == 0:
                        continue
                    else:
                        x, y = max(a, start - allowed), min(b, start + len(target) + allowed)
                        if len(target) - np.isin(target, part[x:y]).sum() > allowed:
                            continue  # each word of the item that is missing is an edit
                        distance, u, v = best_match(part[x:y], target)
                        if distance > allowed:
                            continue
                        best = (distance, x - a + u, x - a + v)
                    found[row, item] = min(found.get((row, item), best), best)
            if found:
                order = sorted(found)
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array([r for r, _ in order], pa.int64())),
                        pa.array([names[k] for _, k in order], pa.int64()),
                        pa.array([found[x][1] for x in order], pa.int64()),
                        pa.array([found[x][2] for x in order], pa.int64()),
                        pa.array([found[x][0] for x in order], pa.int32()),
                    ],
                    ["doc_id", "item_id", "start_word", "end_word", "distance"],
                )

    return docs.mapInArrow(run, MATCHES)


def matches(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, search: Search = Search()
) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance): for each document and item the nearest passage within reach.

    Words are case-folded for A-Z. An item may differ in ``int(search.edits * words)`` words. Items and documents that are null
    or have no words match nothing; a null doc_id stays null, rows that repeat come back as often, items that repeat
    are looked for each. Items are taken in blocks of ITEM_BLOCK, one pass over the documents for
    each block, so what a task holds does not grow with the list. No items or no documents: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    wanted = wanted.where("t is not null")
    found, block = docs.sparkSession.createDataFrame([], MATCHES), []
    for item in wanted.toLocalIterator():
        block.append((item.i, item.t))
        if len(block) == ITEM_BLOCK:
            found, block = found.unionByName(_search_block(rows, block, search)), []
    if block:
        found = found.unionByName(_search_block(rows, block, search))
    return found

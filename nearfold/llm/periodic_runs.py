r"""Periodic runs of words by grammar compression.

A run is a stretch of words with smallest period q (words q apart are identical) that is ``min_length`` words and ``min_exponent`` periods
long or more, and that no neighbouring word extends with that period. They are found in five steps:

1. Re-Pair (Larsson, Moffat, 1999) on the word ids of each text: the most frequent pair of neighbours becomes a nonterminal, again and
   again. A round replaces every repeated pair that is at each of its places more frequent than the pairs that overlap it (ties by the hash
   of the pair), which the order of replacement would do one by one. What is left gets a balanced tree of nonterminals that stand once.
2. For each nonterminal, once, the runs within its words that cross the boundary of its two parts. A run has half its length on one side, so
   the few words beside the boundary come again one period on (or back): only such periods are tried, and each is extended both
   ways by binary search over prefix hashes.
3. Runs of a nonterminal are moved to all places where it is derived.
4. A run of the text crosses the boundary of the smallest nonterminal over it and is found whole there. Shorter intervals, cut by the ends of
   a nonterminal, lie within a whole one of the same period and are dropped.
5. Words that a run contains after its first period are repeats; the text without them is ``collapsed``.

Work and memory grow with n log n of the words of a text, whatever its runs. Texts are taken in pieces of Arrow batches, so a
piece is PIECE bytes or one longer text; nothing is shuffled.

Defined results: words are maximal runs of bytes other than 0x20 and 0x09-0x0D, case counts; a null text is an empty one, without words
or runs, and its collapsed text is "". Rows come back as they are, repeated ones and null ids too; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfold.llm.textbatch import SPACE, hashes, mix, pieces, spans, utf8

PIECE = 1 << 20
CANDIDATES = 1 << 20
_U = np.uint64
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_BASES = (1_174_895_273, 1_930_113_461)


@dataclass(frozen=True)
class Nodes:
    """Nonterminals: ``start``, ``middle`` and ``end`` of one place of each; node i is derived at places[of[i]:of[i + 1]]."""

    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    of: np.ndarray
    places: np.ndarray


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9E3779B97F4A7C15) + mix(b ^ _U(0xD1B54A32D192ED03)))


def grammar(words: np.ndarray, rows: np.ndarray, least: int) -> Nodes:
    """The nonterminals of ``least`` words or more. Row r is words[rows[r]:rows[r + 1]]; no word may stand in two rows."""
    n = len(words)
    symbol, size = np.append(words, _U(0)), np.ones(n + 1, np.int64)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    before = np.append(before, n - 1)[: n + 1]
    before[0] = n
    alive, rank_at = np.ones(n + 1, bool), np.zeros(n + 1, np.int64)
    alive[n] = False
    found: list[tuple[np.ndarray, ...]] = []
    todo = np.arange(max(0, n - 1))
    while len(todo):
        keys = _paired(symbol[todo], symbol[after[todo]])
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], todo[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(begins, len(keys)))
        often = counts >= 2
        if not often.any():
            break
        several = np.repeat(often, counts)
        keys, at = keys[several], at[several]
        kinds, counts = keys[np.append(0, np.cumsum(counts[often])[:-1])], counts[often]
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((kinds, counts))] = np.arange(1, len(kinds) + 1)
        group = np.repeat(np.arange(len(kinds)), counts)
        own = rank[group]
        rank_at[at] = own
        beaten = (rank_at[before[at]] > own) | (rank_at[after[at]] > own)
        rank_at[at] = 0
        chosen = np.bincount(group[beaten], minlength=len(kinds)) == 0
        mine = chosen[group]
        left, group, left_keys = at[mine], group[mine], keys[mine]
        chained = np.zeros(len(left), bool)  # of overlapping places of a pair of equal symbols every second one
        chained[1:] = (after[left[:-1]] == left[1:]) & (group[1:] == group[:-1])
        i = np.arange(len(left))
        even = (i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0
        left, group, left_keys = left[even], group[even], left_keys[even]
        right = after[left]
        middle = left + size[left]
        end = middle + size[right]
        long = end - left >= least
        if long.any():
            found.append((group[long], left[long], middle[long], end[long]))
        symbol[left] = left_keys
        size[left] += size[right]
        after[left] = after[right]
        before[after[left]] = left
        alive[right] = False
        todo = np.unique(np.concatenate([at[~mine], left, before[left]]))
        todo = todo[alive[todo]]
        todo = todo[after[todo] < n]
    starts, middles, ends, counts, places = [], [], [], [], []
    for group, left, middle, end in found:
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        starts.append(left[first]), middles.append(middle[first]), ends.append(end[first])
        counts.append(np.diff(np.append(first, len(group)))), places.append(left)
    begin = np.flatnonzero(alive)
    end = np.append(begin[1:], n)[: len(begin)]
    row = np.searchsorted(rows, begin, "right") - 1
    while True:
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        lefts = np.flatnonzero((place[:-1] % 2 == 0) & (row[1:] == row[:-1])) if len(row) else row
        if not len(lefts):
            break
        long = end[lefts + 1] - begin[lefts] >= least
        starts.append(begin[lefts][long]), middles.append(end[lefts][long]), ends.append(end[lefts + 1][long])
        counts.append(np.ones(int(long.sum()), np.int64)), places.append(begin[lefts][long])
        end = end.copy()
        end[lefts] = end[lefts + 1]
        kept = np.ones(len(row), bool)
        kept[lefts + 1] = False
        begin, end, row = begin[kept], end[kept], row[kept]
    none = [np.zeros(0, np.int64)]
    together = lambda x: np.concatenate([*none, *x])
    return Nodes(together(starts), together(middles), together(ends), np.concatenate([[0], np.cumsum(together(counts))]), together(places))


class _Extender:
    """Lengths of equal stretches by prefix hashes modulo two primes."""

    def __init__(self, words: np.ndarray):
        self.sums, self.powers = [], []
        n = len(words)
        for prime, base in zip(_PRIMES, _BASES):
            p, power, at = _U(prime), np.ones(n + 1, _U), 1
            while at <= n:
                power[at : 2 * at] = power[: len(power[at : 2 * at])] * _U(pow(base, at, prime)) % p
                at *= 2
            total = np.zeros(n + 1, _U)
            np.cumsum(words % p * power[:-1] % p, out=total[1:])
            self.sums.append(total % p), self.powers.append(power)

    def _equal(self, a, b, q):
        """Whether words[a:b] are the words q further on."""
        same = np.ones(len(a), bool)
        for prime, total, power in zip(_PRIMES, self.sums, self.powers):
            p = _U(prime)
            same &= (total[b] + p - total[a]) % p * power[q] % p == (total[b + q] + p - total[a + q]) % p
        return same

    def reach(self, x, q, most, step: int):
        """How many words from x on (step 1) or before x (step -1), at most ``most``, are those q further on."""
        low, high = np.zeros(len(x), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            a = x[open_] if step > 0 else x[open_] - mid
            good = self._equal(a, a + mid, q[open_])
            low[open_] = np.where(good, mid, low[open_])
            high[open_] = np.where(good, high[open_], mid - 1)


def _window(length: int, exponent: int) -> int:
    """So many words beside a boundary, on the side with the longer part of a run, come again one period further."""
    return min((max(length, exponent * q) + 1) // 2 - q for q in range(1, length + 1))


def crossing(words: np.ndarray, nodes: Nodes, min_length: int, min_exponent: int) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs within the place of each node that cross its middle, cut at its ends."""
    n, g = len(words), _window(min_length, min_exponent)
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    if n < min_length or not len(nodes.start):
        return empty
    gram = words[: n - g + 1]
    for k in range(1, g):
        gram = _paired(gram, words[k : n - g + 1 + k])
    order = np.argsort(gram, kind="stable")
    sorted_ = gram[order]
    group = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    code = group * (n + 1) + order  # by gram, then by place
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    s, m, e = nodes.start, nodes.middle, nodes.end
    widest = (e - s) // min_exponent
    some = np.flatnonzero(m + g <= e)
    b = m[some]
    right = (some, where[b] + 1, np.searchsorted(code, group[where[b]] * (n + 1) + np.minimum(b + widest[some], e[some] - g), "right"))
    some_left = np.flatnonzero(m - g >= s)
    b = m[some_left] - g
    left = (some_left, np.searchsorted(code, group[where[b]] * (n + 1) + np.maximum(s[some_left], b - widest[some_left]), "left"), where[b])
    found, extender = [], None
    for side, (some, lo, hi) in (("right", right), ("left", left)):
        count = np.maximum(0, hi - lo)
        some, lo, count = some[count > 0], lo[count > 0], count[count > 0]
        if not len(some):
            continue
        extender = extender or _Extender(words)

        def tried(node, place, side=side):
            q = place - m[node] if side == "right" else m[node] - g - place
            x = m[node] if side == "right" else m[node] - q
            start = x - extender.reach(x, q, x - s[node], -1)
            end = x + q + extender.reach(x, q, e[node] - x - q, 1)
            whole = end - start >= np.maximum(min_length, min_exponent * q)
            return node[whole], start[whole], end[whole], q[whole]

        # the nearest first: multiples of its period, up to the length of its run, give the same interval
        nearest = tried(some, order[lo] if side == "right" else order[lo + count - 1])
        found.append(nearest)
        period, length = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        period[nearest[0]], length[nearest[0]] = nearest[3], nearest[2] - nearest[1]
        upto, i = np.cumsum(count), 0
        while i < len(some):  # so many candidates at once, or those of one node
            done = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, done + CANDIDATES, "right")))
            c = count[i:j]
            node = np.repeat(some[i:j], c)
            place = order[np.repeat(lo[i:j] - (upto[i:j] - c - done), c) + np.arange(int(c.sum()))]
            q = place - m[node] if side == "right" else m[node] - g - place
            known = (period[node] > 0) & (q <= length[node]) & (q % np.maximum(1, period[node]) == 0)
            found.append(tried(node[~known], place[~known]))
            i = j
    if not found:
        return empty
    node, start, end, q = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((q, end, start, node))
    node, start, end, q = node[by], start[by], end[by], q[by]
    new = np.ones(len(node), bool)  # of one interval the smallest period; the others are multiples of it
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], q[new]


def runs_of(words: np.ndarray, rows: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> tuple[np.ndarray, ...]:
    """(row, start, end, period) of all runs, by row, start and period; places are those in ``words``, as for ``grammar``."""
    nodes = grammar(words, rows, min_length)
    node, start, end, q = crossing(words, nodes, min_length, min_exponent)
    count = nodes.of[node + 1] - nodes.of[node]
    first = np.repeat(nodes.of[node] - (np.cumsum(count) - count), count)
    shift = nodes.places[first + np.arange(len(first))] - np.repeat(nodes.start[node], count)
    start, end, q = np.repeat(start, count) + shift, np.repeat(end, count) + shift, np.repeat(q, count)
    row = np.searchsorted(rows, start, "right") - 1
    by = np.lexsort((-end, start, q, row))
    row, start, end, q = row[by], start[by], end[by], q[by]
    if not len(row):
        return row, start, end, q
    group = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (q[1:] != q[:-1])]))
    reach = end + group * (len(words) + 1)
    whole = np.ones(len(row), bool)
    whole[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    row, start, end, q = row[whole], start[whole], end[whole], q[whole]
    by = np.lexsort((q, start, row))
    return row[by], start[by], end[by], q[by]


def _collapsed(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, repeat: np.ndarray) -> pa.Array:
    """The words that are no repeats, joined by one space."""
    inside = ~SPACE[data]
    if repeat.any():
        up, down = np.zeros(len(data) + 1, np.int32), np.zeros(len(data) + 1, np.int32)
        up[starts[repeat]], down[ends[repeat]] = 1, 1
        inside &= np.cumsum(up - down)[:-1] == 0
    kept = np.flatnonzero(~repeat)
    row = np.searchsorted(rows, kept, "right") - 1
    follows = np.zeros(len(kept), bool)
    follows[:-1] = row[1:] == row[:-1]
    data = data.copy()
    data[ends[kept[follows]]] = 0x20
    inside[ends[kept[follows]]] = True
    upto = np.concatenate([[0], np.cumsum(inside)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data[inside].tobytes())).cast(pa.string())


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find(docs: DataFrame, id_col: str, text_col: str, min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of every row; runs are (start, length, period) in words from 0, by start and period."""
    if min_exponent < 3:
        raise ValueError("runs of less than three periods are not looked for")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets, PIECE):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, rows = spans(part, at)
                of = np.repeat(np.arange(j - i, dtype=_U), np.diff(rows))
                words = mix(hashes(part, starts, ends) + of * _U(0xA0761D6478BD642F))
                row, start, end, q = runs_of(words, rows, min_length, min_exponent)
                marks = np.zeros(len(words) + 1, np.int64)
                np.add.at(marks, start + q, 1)
                np.add.at(marks, end, -1)
                repeat = np.cumsum(marks)[:-1] > 0
                structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - rows[row], end - start, q)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32()), structs)
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(rows), pa.int64()), lists, _collapsed(part, at, starts, ends, rows, repeat)]
                yield pa.record_batch(columns, [id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs {RUNS}, collapsed string")

r"""Substring dedup by hashing units: lines, paragraphs, and runs of words between content-defined cuts.

Units are normalised (words only, A-Z as a-z), their 128-bit digests grouped over all documents, the
occurrence with the smallest (id, offset) kept and every other one removed, with
its offsets in the original text. A unit is

* every \n-split line with a word, however short,
* every paragraph: lines without a line that has no word between them, and
* for each cut, the words from it to the first cut at least ``min_words`` words on. A cut
  lies after a word that ends a sentence and, in every run of ``span(min_words)`` words without such a
  word, after those of the least hash; and at line starts. So a passage with the same line breaks
  has the same cuts wherever it stands, but for its first and last span less one words, and
  no cut is more than a span from the next. Line hashing alone misses passages
  that begin or end within a line.

Repeated units that touch in a document are one span, and a span is removed if it has ``min_words`` words or more: ten short
lines in a row that stand elsewhere too are, one short line that many texts have by chance is not. With ``min_places`` a span
is also removed, however short, if it holds a line or paragraph that stands in as many places. ``repeated_units`` gives all
repeated lines and paragraphs as rows, those that are not removed too; the runs are an option of ``repeats``.
A passage of ``2 * min_words`` words or more holds a whole unit. Where it stands in two places, the later
occurrence goes but for the words before its first and after its last common cut.

The texts are read twice. The first pass counts digests; the second gives the places of those found more than once, with a bit
filter of fixed size before the shuffle. So most units never travel with their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from nearfold.llm.textbatch import LOWER, filter_bits, hashes, lines, mix, passing, pieces, spans, utf8
from nearfold.plans.storage import scratch, written

MIN_WORDS = 25
LINE, PARAGRAPH, RUN = 1, 2, 4
_U = np.uint64
_K = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _known.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, _U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 22:
            _known[base] = have
    return have[:n]


def _runs(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Two digests of words[first:last] for each pair, from prefix sums; equal runs have equal digests wherever they stand."""
    n, found = len(words) + 1, []
    for i, base in enumerate(_K):
        own = mix(words ^ base) if i else words
        total = np.zeros(n, _U)
        np.cumsum(own * _powers(int(base), n)[:-1], out=total[1:])
        down = _powers(pow(int(base), -1, 1 << 64), n)
        found.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(_U)))
    return found


def span(min_words: int) -> int:
    """The greatest distance of cuts: the two ends of a unit are then chosen by spans inside any 2 * min_words words."""
    return max(1, (min_words + 2) // 3)


STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True


def _least(words: np.ndarray, row: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Marks the words of the least hash in every run of ``width`` words of one row that holds none of ``ends``."""
    marked = np.zeros(len(words), bool)
    if len(words) < width:
        return marked
    upto = np.concatenate([[0], np.cumsum(ends)])
    runs = np.flatnonzero((upto[width:] == upto[:-width]) & (row[width - 1 :] == row[: len(row) - width + 1]))
    least = np.lib.stride_tricks.sliding_window_view(words, width)[runs].min(1) if len(runs) else words[:0]
    for k in range(width):  # equal words of a run are all marked
        place = runs + k
        marked[place[words[place] == least]] = True
    return marked


def _units(stop: np.ndarray, words: np.ndarray, rows: np.ndarray, breaks: np.ndarray, of: np.ndarray, min_words: int | None):
    """(row, first word, end word, kind) of the units of several rows; no runs without ``min_words``. Row r has the words rows[r] to rows[r + 1] and the lines of[r] to
    of[r + 1], line i the words from breaks[i] on. A unit that is of several kinds comes once, with all their bits."""
    n, found = len(words), []
    size = np.diff(rows)
    has = np.diff(np.append(breaks, n)) > 0
    opens = has.copy()
    opens[1:] &= ~has[:-1]
    first_lines = of[:-1]
    opens[first_lines] = has[first_lines]
    # a row without words ends the paragraph and the line before it; rows begin new ones, so the next begin is the end
    for kind, some in ((LINE, has), (PARAGRAPH, opens)):
        begin = breaks[some]
        found.append((begin, np.append(begin[1:], n), np.full(len(begin), kind)))
    row = np.repeat(np.arange(len(size)), size)
    if min_words is not None:
        cut = np.zeros(n + 1, bool)
        cut[rows] = True
        cut[breaks[has]] = True
        cut[np.flatnonzero(stop | _least(words, row, stop, span(min_words))) + 1] = True
        cuts = np.flatnonzero(cut)
        begin = cuts[cuts < n]
        to = np.searchsorted(cuts, begin + min_words)
        some = np.flatnonzero(to < len(cuts))
        some = some[cuts[to[some]] <= rows[row[begin[some]] + 1]]
        found.append((begin[some], cuts[to[some]], np.full(len(some), RUN)))
    first, last, kind = (np.concatenate(x) for x in zip(*found))
    key, which = np.unique(first * (n + 1) + last, return_inverse=True)
    kinds = np.zeros(len(key), np.int64)
    for bit in (LINE, PARAGRAPH, RUN):
        kinds[which[kind == bit]] |= bit
    first = key // (n + 1)
    return row[first], first, key % (n + 1), kinds


def _batch_units(batch, column: int, min_words: int | None):
    """For each piece of a batch: the rows, words, units (first, end, kind) and their places in characters of the text."""
    data, offsets = utf8(batch.column(column))
    for i, j in pieces(offsets):
        some = data[offsets[i] : offsets[j]]
        places = offsets[i : j + 1] - offsets[i]
        low = LOWER[some]
        starts, ends, rows = spans(low, places)
        if not len(starts):
            continue
        words = hashes(low, starts, ends)
        begin, _, of = lines(some, places)
        row, first, last, kinds = _units(STOPS[low[ends - 1]], words, rows, np.searchsorted(starts, begin), of, min_words)
        chars = np.concatenate([[0], np.cumsum((some & 0xC0) != 0x80)])
        base = chars[places[row]]
        yield i + row, words, rows[row], first, last, kinds, chars[starts[first]] - base, chars[ends[last - 1]] - base


def _digests(docs: DataFrame, min_words: int | None) -> DataFrame:
    """(d1): the first digest of every unit of every text."""

    def run(batches):
        for batch in batches:
            for _, words, _, first, last, *_ in _batch_units(batch, 0, min_words):
                yield pa.record_batch([pa.array(_runs(words, first, last)[0].view(np.int64))], ["d1"])

    return docs.select("text").mapInArrow(run, "d1 long")


def _places(docs: DataFrame, min_words: int | None, bits: np.ndarray) -> DataFrame:
    """(d1, d2, doc_id, first, last, start, end, kind) of the units that pass the filter: their words and characters in the text."""

    def run(batches):
        for batch in batches:
            for row, words, base, first, last, kinds, start, end in _batch_units(batch, 1, min_words):
                d1, d2 = (x.view(np.int64) for x in _runs(words, first, last))
                some = np.flatnonzero(passing(d1, bits))
                if len(some):
                    rest = (first - base, last - base, start, end, kinds)
                    columns = [pa.array(d1[some]), pa.array(d2[some]), batch.column(0).take(pa.array(row[some])), *(pa.array(x[some].astype(np.int32)) for x in rest)]
                    yield pa.record_batch(columns, ["d1", "d2", "doc_id", "first", "last", "start", "end", "kind"])

    return docs.mapInArrow(run, "d1 long, d2 long, doc_id long, first int, last int, start int, end int, kind int")


def _repeated(docs: DataFrame, id_col: str, text_col: str, min_words: int | None) -> DataFrame:
    """``_places`` of the units that stand in two places or more, as a written table; with false hits of the filter and single places of repeated rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    often = _digests(rows, min_words).groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1")
    often = written(often, "often")
    some = _places(rows, min_words, filter_bits(often, "d1")).join(often.hint("merge"), "d1")
    return written(some, "places")


def _first(some: DataFrame) -> DataFrame:
    """(d1, d2, kept, other, places): the first and last place of each unit that has several."""
    place = F.struct("doc_id", "start")
    return some.groupBy("d1", "d2").agg(F.min(place).alias("kept"), F.max(place).alias("other"), F.count("*").alias("places")).where("kept <> other")


def _hot(min_places: int | None):
    """Whether a line or paragraph stands in ``min_places`` places."""
    if min_places is None:
        return F.lit(False)
    return (F.col("places") >= min_places) & (F.col("kind").bitwiseAND(LINE | PARAGRAPH) > 0)


def _single(some: DataFrame) -> DataFrame:
    """Each place once, so that repeated rows count once."""
    return some.dropDuplicates(["d1", "d2", "doc_id", "start"])


def repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, runs: bool = True, min_places: int | None = None) -> DataFrame:
    """(doc_id, start, end, first_doc_id, first_start, words, by_lines, by_runs): the spans to remove, disjoint within a document.

    first_doc_id and first_start tell where the kept occurrence of the span's first unit stands, words how long the span is,
    by_lines and by_runs whether lines or paragraphs, and runs between cuts, are among its units. Without ``runs`` lines and paragraphs alone are
    units. Null and wordless texts have no units; rows with a null id take no part; an id names one text, and a repeated
    row counts once. Other columns are ignored, an empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as kept:
        some = _repeated(docs, id_col, text_col, min_words if runs else None)
        first = written(_first(some if min_places is None else _single(some)).select("d1", "d2", "kept", "places"), "first")
        again = some.join(first.hint("merge"), ["d1", "d2"]).where("kept <> struct(doc_id, start)").withColumn("hot", _hot(min_places))
        return kept(_spans(_marked(again)).where((F.col("words") >= min_words) | F.col("hot")).drop("hot"), "repeats")


def repeated_units(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, min_places: int | None = None) -> DataFrame:
    """(doc_id, start, end, line, paragraph, words, places, first_doc_id, first_start, removed): each place of every repeated line and paragraph.

    Units of any length, the kept first place of each among the rows; ``line`` and ``paragraph`` tell what a unit is there, places in how many
    places it stands. ``removed`` are the later places inside spans that ``repeats`` without runs gives. Nulls, repeated rows and empty tables: as there.
    """
    with scratch(docs.sparkSession) as kept:
        some = written(_single(_repeated(docs, id_col, text_col, None)), "units")
        all_places = written(some.join(written(_first(some).drop("other"), "first").hint("merge"), ["d1", "d2"]), "all")
        again = _marked(all_places.where("kept <> struct(doc_id, start)").withColumn("hot", _hot(min_places)))
        again = written(again, "marked")
        gone = again.groupBy("doc_id", "span").agg((F.max("last") - F.min("first")).alias("n"), F.max("hot").alias("hot"))
        gone = written(gone.where((F.col("n") >= min_words) | F.col("hot")).select("doc_id", "span"), "gone")
        gone = again.join(gone.hint("merge"), ["doc_id", "span"]).select("doc_id", "first", F.lit(True).alias("gone"))
        found = all_places.join(gone.hint("merge"), ["doc_id", "first"], "left")
        result = found.select(
            "doc_id",
            F.col("start").cast("long").alias("start"),
            F.col("end").cast("long").alias("end"),
            (F.col("kind").bitwiseAND(LINE) > 0).alias("line"),
            (F.col("kind").bitwiseAND(PARAGRAPH) > 0).alias("paragraph"),
            (F.col("last") - F.col("first")).cast("long").alias("words"),
            "places",
            F.col("kept.doc_id").alias("first_doc_id"),
            F.col("kept.start").cast("long").alias("first_start"),
            (F.col("gone").isNotNull() & F.expr("kept <> struct(doc_id, start)")).alias("removed"),
        )
        return kept(result, "units")


def _marked(again: DataFrame) -> DataFrame:
    """One row per document and first word, with the number of the span it is in: units that overlap or follow one another share one."""
    again = again.groupBy("doc_id", "first").agg(
        F.max("last").alias("last"), F.max("end").alias("end"), F.min("start").alias("start"), F.min("kept").alias("kept"), F.bit_or("kind").alias("kind"),
        F.max("hot").alias("hot"),
    )
    by = Window.partitionBy("doc_id").orderBy("first")  # one document's units
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = again.withColumn("opens", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    return marked.withColumn("span", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def _spans(marked: DataFrame) -> DataFrame:
    """The repeated units of each document that share a span as one."""
    merged = marked.groupBy("doc_id", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kept", "first").alias("kept"),
        (F.max("last") - F.min("first")).alias("words"), F.bit_or("kind").alias("kind"), F.max("hot").alias("hot"),
    )
    return merged.select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        F.col("kept.doc_id").alias("first_doc_id"),
        F.col("kept.start").cast("long").alias("first_start"),
        F.col("words").cast("long").alias("words"),
        (F.col("kind").bitwiseAND(LINE | PARAGRAPH) > 0).alias("by_lines"),
        (F.col("kind").bitwiseAND(RUN) > 0).alias("by_runs"),
        "hot",
    )


def without_repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, runs: bool = True, min_places: int | None = None) -> DataFrame:
    """``docs`` with the spans of ``repeats`` cut out of the texts; all rows and columns stay."""
    cut = repeats(docs, id_col, text_col, min_words, runs, min_places)
    cut = cut.groupBy(F.col("doc_id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    joined = docs.join(cut, F.col(id_col) == F.col("_of"), "left")
    text = F.col(text_col).cast("string")
    start = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cut", lambda c: c["end"]))
    end = F.concat(F.transform("_cut", lambda c: c["start"]), F.array(F.length(text).cast("long")))
    kept = F.array_join(F.zip_with(start, end, lambda a, b: F.substring(text, a + 1, b - a)), "")
    return joined.withColumn(text_col, F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)

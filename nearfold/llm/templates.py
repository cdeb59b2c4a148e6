r"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of words, then by its first LEAD words; words with a digit are the field <*>
from the start. A leaf so holds lines of one length and one opening. There, each word in each place has a
support: the number of classes (below) whose documents have it there. The templates of a line keep the words whose
support reaches ``min_docs``, twice that, four times that and so on, and make the others fields; so a line has its own words
as its most special template and merges with ever more lines of the leaf as names, titles and other values give way. A
template must be similar enough to the line: SIMILAR of the words kept, one of them without a digit. A template recurs if
documents of ``min_docs`` classes or more hold a line of it, and a line goes if one of its templates recurs.

All this is keyed aggregates on (leaf, place, word) and on template digests, so no leaf is ever collected. A leaf that fewer than
``min_docs`` documents share ends there: most lines of prose do, and their words are never shuffled.

A class is a component of near copies, which so counts once however large it is. Two texts are near copies if about NEAR
of their word pairs are the same: their sketches (a least hash for each of BINS) agree in as many places. Only texts that
agree in all ROWS places of a band are compared, with the least of the band, so no shared line can join other texts.

Not recognised: a field without a digit among the first LEAD words of a line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfold.llm.textbatch import filter_bits, hashes, lines, mix, passing, pieces, spans, utf8
from nearfold.operators.components import connected_components
from nearfold.plans.storage import scratch, written

LEAD = 2
SIMILAR = 0.6
MIN_DOCS = 5
_U = np.uint64
_FIELD = _U(0x2545F4914F6CDD1D)
BINS = 192
ROWS = 8
NEAR = 0.7
KEYED = "doc_id long, text_hash long, line int, leaf long, w1 long, w2 long, bands array<long>, sketch binary"
LINE = ["leaf", "w1", "w2"]


def _digest(words: np.ndarray, kept: np.ndarray, first: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each line from the words that are ``kept`` and their places; line i has the words first[i] to first[i] + size[i]."""
    place = (np.arange(len(words)) - np.repeat(first, size)).astype(_U)
    upto = np.zeros(len(words) + 1, _U)
    np.cumsum(np.where(kept, mix(words ^ mix(place + _U(seed))), _U(0)), out=upto[1:])
    return mix(upto[first + size] - upto[first] + mix(size.astype(_U) + _U(seed << 8)))


def line_keys(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaf of each line and a 128-bit digest of it. Lines follow one another; fields with digits are generalised already."""
    lead = np.arange(len(words)) - np.repeat(first, size) < LEAD
    return _digest(words, lead, first, size, 1), *(_digest(words, np.ones(len(words), bool), first, size, s) for s in (2, 3))


def sketches(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The least hash of a word pair in each of BINS bins, for each row; row i has the words rows[i] to rows[i + 1], one at least.
    An empty bin takes from the next one that is not."""
    after = np.append(words[1:], _U(0))
    after[rows[1:] - 1] = 0
    pairs = mix(words + mix(after))
    place = np.repeat(np.arange(len(rows) - 1) * BINS, np.diff(rows)) + ((pairs >> _U(32)) % _U(BINS)).astype(np.int64)
    none = ~_U(0)
    out = np.full((len(rows) - 1) * BINS, none)
    np.minimum.at(out, place, pairs)
    out = out.reshape(-1, BINS)
    while len(short := np.flatnonzero((out == none).any(1))):
        some = out[short]
        taken = np.roll(some, -1, axis=1)
        out[short] = np.where(some == none, np.where(taken == none, none, mix(taken)), some)
    return out


def _parsed(batch, column: int):
    """For each piece of a batch: its first row, row bounds in words, word hashes, lines with a word (number, row, first word, size)."""
    data, offsets = utf8(batch.column(column))
    for i, j in pieces(offsets, 1 << 20):
        some, places = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, at = spans(some, places)
        if not len(starts):
            continue
        words = hashes(some, starts, ends)
        digits = np.concatenate([[0], np.cumsum((some >= 48) & (some <= 57))])
        begin, _, of = lines(some, places)
        bounds = np.append(np.searchsorted(starts, begin), len(starts))
        held = np.flatnonzero(np.diff(bounds))
        row = np.searchsorted(of, held, "right") - 1
        fields = np.where(digits[ends] > digits[starts], _FIELD, words)
        yield i, at, words, fields, held - of[row], row, bounds[held], np.diff(bounds)[held]


def _keyed(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: document, number of the line, leaf and digest; and one row for each
    text with a word, with line -1, the keys of the bands of its sketch and the sketch in one byte a bin."""

    def run(batches):
        for batch in batches:
            for i, at, words, fields, line, row, first, size in _parsed(batch, 2):
                full = np.flatnonzero(np.diff(at))
                sketch = sketches(words, np.append(at[full], len(words)))
                bands = np.zeros((len(full), BINS // ROWS), _U) + np.arange(BINS // ROWS, dtype=_U)
                for k in range(ROWS):
                    bands = mix(bands ^ sketch[:, k::ROWS])
                none = pa.nulls(len(full), pa.int64())
                ends = np.arange(len(full) + 1, dtype=np.int32) * (BINS // ROWS)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))
                yield _rows(batch, full + i, np.full(len(full), -1), [none] * 3, bands, pa.array([x.tobytes() for x in sketch.astype(np.uint8)], pa.binary()))
                keys = [pa.array(x.view(np.int64)) for x in line_keys(fields, first, size)]
                yield _rows(batch, row + i, line, keys, pa.nulls(len(row), pa.list_(pa.int64())), pa.nulls(len(row), pa.binary()))

    return docs.mapInArrow(run, KEYED)


def _rows(batch, take, line, keys, bands, sketch) -> pa.RecordBatch:
    take = pa.array(take)
    return pa.record_batch(
        [batch.column(0).take(take), batch.column(1).take(take), pa.array(line.astype(np.int32)), *keys, bands, sketch],
        ["doc_id", "text_hash", "line", "leaf", "w1", "w2", "bands", "sketch"],
    )


def _words_of(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, w1, w2, words): each distinct line of the leaves, with its words as hashes."""
    bits = filter_bits(leaves, "leaf")

    def run(batches):
        for batch in batches:
            for _, _, _, fields, _, _, first, size in _parsed(batch, 0):
                leaf, w1, w2 = line_keys(fields, first, size)
                _, one = np.unique(w1, return_index=True)  # the others come again from here or from elsewhere
                one = one[passing(leaf[one].view(np.int64), bits)]
                if len(one):
                    n = size[one]
                    at = np.repeat(first[one] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(fields[at].view(np.int64)))
                    yield pa.record_batch([*(pa.array(x[one].view(np.int64)) for x in (leaf, w1, w2)), words], [*LINE, "words"])

    found = docs.select("text").mapInArrow(run, "leaf long, w1 long, w2 long, words array<long>")
    found = found.groupBy(*LINE).agg(F.first("words").alias("words"))
    return written(found.join(leaves.hint("merge"), "leaf", "left_semi"), "words")


def _templates(supported: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, w1, w2, t1, t2): the digests of the templates of each line; ``supported`` has LINE and words, an array of (word, support)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            if not len(size):
                continue
            each, first = lists.flatten(), np.cumsum(size) - size
            words = each.field(0).to_numpy(False).view(_U)
            held = each.field(1).to_numpy(False)
            digit = words == _FIELD
            lines_, keys, level = [], [], min_docs
            while True:
                solid = (held >= level) & ~digit
                kept = np.add.reduceat(solid | digit, first, dtype=np.int64)
                some = np.flatnonzero((kept >= SIMILAR * size) & np.logical_or.reduceat(solid, first))
                if not len(some):
                    break
                lines_.append(some)
                keys.append(np.stack([_digest(words, solid | digit, first, size, s)[some] for s in (4, 5)], 1))
                level *= 2
            if lines_:
                line, key = np.concatenate(lines_), np.concatenate(keys)
                _, one = np.unique(np.column_stack([line.astype(_U), key]), axis=0, return_index=True)
                take = pa.array(line[one])
                yield pa.record_batch([*(batch.column(k).take(take) for k in range(3)), *(pa.array(key[one, k].view(np.int64)) for k in (0, 1))], [*LINE, "t1", "t2"])

    return supported.select(*LINE, "words").mapInArrow(run, "leaf long, w1 long, w2 long, t1 long, t2 long")


def _near(batches):
    for batch in batches:
        a, b = (np.array(batch.column(k).to_pylist(), f"V{BINS}").view(np.uint8).reshape(-1, BINS) for k in (2, 3))
        yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((a == b).sum(1) >= NEAR * BINS))


def _classes(keyed: DataFrame) -> DataFrame:
    """(doc_id, class): the component of near copies of each document; copies are one text from the start."""
    whole = keyed.where("line = -1")
    texts = written(whole.groupBy("text_hash").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sketches")
    bands = texts.select("text_hash", F.explode("bands").alias("band"))
    least = bands.groupBy("band").agg(F.min("text_hash").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b")
    pairs = bands.join(written(least, "bands").hint("merge"), "band").where("text_hash <> b").select(F.col("text_hash").alias("a"), "b").distinct()
    of = lambda end: texts.select(F.col("text_hash").alias(end), F.col("sketch").alias("sketch_" + end)).hint("merge")
    compared = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sketch_a", "sketch_b")
    found = connected_components(compared.mapInArrow(_near, "a long, b long"), "a", "b")
    mine = whole.select("doc_id", "text_hash").join(found.hint("merge"), F.col("text_hash") == F.col("node"), "left")
    return mine.groupBy("doc_id").agg(F.min(F.coalesce("component", "text_hash")).alias("class"))


def recurring_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, lines): for each document the numbers (from 0) of the lines of which a template recurs."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = rows.where("text is not null")
    with scratch(docs.sparkSession) as kept:
        keyed = written(_keyed(rows), "line-keys")
        each = keyed.where("line >= 0").select("doc_id", "text_hash", "line", *LINE)
        # a document counts once for a leaf, a repeated row once altogether
        often = each.groupBy("leaf", "doc_id").agg(F.lit(1).alias("n")).groupBy("leaf").agg(F.sum("n").alias("docs"))
        leaves = written(often.where(F.col("docs") >= min_docs).select("leaf"), "leaves")
        held = written(each.join(leaves.hint("merge"), "leaf"), "held")
        of = _classes(keyed).withColumnRenamed("doc_id", "_id")
        places = held.select(*LINE, "doc_id").distinct().join(of.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")))
        places = written(places.select(*LINE, "class").distinct(), "places")
        lines_ = places.groupBy(*LINE).agg(F.count("*").alias("classes"))
        words = _words_of(rows, leaves).join(lines_.hint("merge"), LINE)
        words = written(words.select(*LINE, "classes", F.posexplode("words").alias("place", "word")), "places-of-words")
        support = written(words.groupBy("leaf", "place", "word").agg(F.sum("classes").alias("held")), "support")
        supported = words.join(support.hint("merge"), ["leaf", "place", "word"]).groupBy(*LINE).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "word", "held"))), lambda x: F.struct(x["word"].alias("word"), x["held"].alias("held"))).alias("words")
        )
        templates = written(_templates(supported, min_docs), "templates")
        holders = places.join(templates.hint("merge"), LINE).select("leaf", "t1", "t2", "class").distinct()
        found = holders.groupBy("leaf", "t1", "t2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
        gone = templates.join(written(found.select("leaf", "t1", "t2"), "recur").hint("merge"), ["leaf", "t1", "t2"])
        hit = held.join(written(gone.select(*LINE).distinct(), "gone").hint("merge"), LINE)
        hit = hit.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("lines"))
        return kept(hit, "recurring")


def without_recurring(docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS) -> DataFrame:
    r"""``docs`` with the lines of recurring templates dropped from the texts, and two columns more.

    n_lines (\n-split lines) and n_dropped. All rows and columns stay, a null text stays null with
    n_lines 0, lines without a word are never dropped. Repeated rows count once. Null ids count as one
    document. Columns named n_lines or n_dropped in the input raise. An empty table gives an empty one.
    """
    clash = {"n_lines", "n_dropped"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are given by without_recurring")
    hits = recurring_lines(docs, id_col, text_col, min_docs)
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lines").alias("_lines"))
    text = F.col(text_col).cast("string")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    joined = docs.join(hits.hint("merge"), same, "left")  # as many rows as documents: never a broadcast
    split = F.split(text, "\n", -1)

    def rest(parts):
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_lines"))  # by hash: linear in the lines
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")

    kept = F.get(F.transform(F.array(split), rest), 0)  # split once, not for each line
    return joined.select(
        *(
            (F.when(F.col("_lines").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(c))
            for c in docs.columns
        ),
        F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_dropped"),
    )

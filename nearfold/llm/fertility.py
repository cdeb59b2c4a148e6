r"""Quality rules by tokeniser fertility.

Public vocabularies, none trained here, measure a text: characters per token and the entropy
of its tokens under a byte-level BPE, and the share of its bytes that a piece vocabulary can only
spell as bytes (byte fallback). A text outside the band of its language, or of its script
where the language has none, is rejected: shouting, symbol soup, tables of fragments and
encoding damage cost more tokens per character than prose, and looping text has low entropy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from nearfold.llm.chunkcoder import coder
from nearfold.llm.textbatch import SPACE, hashes, lines, mix, pieces, spans, utf8

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# The byte pieces <0x00> to <0xFF> of the piece vocabulary have these ids.
BYTE_PIECES = (3, 258)
CACHE_WORDS = 500_000
SCRIPTS = ("latin", "greek", "cyrillic", "other")
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, entropy double, fallback_share double, script string"
)


@dataclass(frozen=True)
class Band:
    """Limits of a language or script; a text outside of any of them is rejected."""

    chars_per_token: tuple[float, float]
    entropy: tuple[float, ...]  # least entropy for texts of ENTROPY_STEPS tokens or more
    fallback_share: float


ENTROPY_STEPS = (0, 150, 300, 600, 1200)
# Fixed values. Languages: below what 998 of 1000 texts labelled good reach, read off 16,906 labelled rows
# of one 0.1 GB table; scripts: wide limits for languages without a band of their own.
BANDS: dict[str, Band] = {
    "en": Band((1.85, 9.0), (5.50, 5.80, 6.20, 6.47, 6.70), 0.1),
    "fr": Band((1.60, 9.0), (5.30, 5.62, 5.95, 6.20, 6.38), 0.1),
    "de": Band((1.78, 9.0), (5.40, 5.70, 6.07, 6.30, 6.50), 0.1),
    "es": Band((1.58, 9.0), (5.20, 5.48, 5.88, 6.14, 6.33), 0.1),
    "latin": Band((1.30, 9.0), (4.50, 4.80, 5.00, 5.20, 5.40), 0.2),
    "greek": Band((0.40, 9.0), (3.00, 3.20, 3.40, 3.60, 3.80), 0.5),
    "cyrillic": Band((0.40, 9.0), (3.00, 3.20, 3.40, 3.60, 3.80), 0.5),
    "other": Band((0.20, 9.0), (3.00, 3.20, 3.40, 3.60, 3.80), 1.0),
}


class Fallback:
    """Bytes of words that the piece vocabulary spells byte by byte; only words with other than printable ASCII are asked for."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[int, int] = {}

    def __call__(self, data, starts, ends, words) -> np.ndarray:
        odd = np.concatenate([[0], np.cumsum((data >= 0x7F) | (data < 0x20))])
        found = np.zeros(len(starts), np.int64)
        ask = np.flatnonzero(odd[ends] > odd[starts])
        keys, first, which = np.unique(words[ask], return_index=True, return_inverse=True)
        new = [k for k, key in enumerate(keys.tolist()) if key not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, list(range(len(keys)))
        raw = data.tobytes()
        texts = [raw[starts[i] : ends[i]].decode() for i in ask[first[new]]] if new else []
        for k, ids in zip(new, self.pieces.encode(texts, num_threads=1) if texts else []):
            self.known[int(keys[k])] = sum(BYTE_PIECES[0] <= i <= BYTE_PIECES[1] for i in ids)
        found[ask] = np.array([self.known[k] for k in keys.tolist()], np.int64)[which] if len(keys) else 0
        return found


def _repeated_words(row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each word whether it is in a 3-word window that its row holds twice or more."""
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        inside = row[2:] == row[:-2]
        at = np.flatnonzero(inside)
        key = mix(mix(mix(words[at]) + words[at + 1]) + words[at + 2]) ^ mix(row[at].astype(np.uint64))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[which] > 1]
        for j in range(3):
            covered[twice + j] = True
    return covered


def _script(some: np.ndarray, chars: np.ndarray) -> int:
    """0 Latin, 1 Greek, 2 Cyrillic, 3 other, by the lead bytes of most letters."""
    leads = np.bincount(some, minlength=256)
    latin = leads[65:91].sum() + leads[97:123].sum() + leads[0xC3:0xCA].sum()
    return int(np.argmax([latin, leads[0xCE:0xD0].sum(), leads[0xD0:0xD4].sum(), leads[0xD4:0xF5].sum()]))


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, vocabulary: str, piece_model: str) -> DataFrame:
    """doc_id, lang and MEASURES for every row; a null text is empty and has zeros (chars_per_token and entropy 0)."""
    fallbacks: list[Fallback] = []

    def run(batches):
        if not fallbacks:
            fallbacks.append(Fallback(piece_model))
        encode = coder(vocabulary)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            out: list[list[np.ndarray]] = []
            for i, j in pieces(offsets):
                some, places = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n = j - i
                starts, ends, rows = spans(some, places)
                words = hashes(some, starts, ends)
                row = np.repeat(np.arange(n), np.diff(rows))
                lead = np.concatenate([[0], np.cumsum((some & 0xC0) != 0x80)])
                total = lambda x: np.bincount(row, x, n).astype(np.int64)
                l_start, l_end, of = lines(some, places)
                held = np.searchsorted(starts, l_start) < np.searchsorted(starts, l_end)
                l_row = np.repeat(np.arange(n), np.diff(of))
                key = hashes(some, l_start, l_end) ^ mix(l_row.astype(np.uint64))
                _, first = np.unique(key[held], return_index=True)
                dup = np.bincount(l_row[held], minlength=n) - np.bincount(l_row[held][first], minlength=n)
                symbols = np.concatenate([[0], np.cumsum(SYMBOLS[some])])
                size, entropy, script = [], [], []
                for r, ids in enumerate(encode.encode(some, places)):
                    size.append(len(ids))
                    count = np.unique(ids, return_counts=True)[1]
                    entropy.append(float(np.log2(len(ids)) - (count * np.log2(count)).sum() / len(ids)) if len(ids) else 0.0)
                    script.append(SCRIPTS[_script(some[places[r] : places[r + 1]], lead)])
                size = np.array(size, np.int64)
                word_chars = total(lead[ends] - lead[starts])
                fallback = total(fallbacks[0](some, starts, ends, words))
                solid = np.bincount(row, ends - starts, n)
                out.append(
                    [
                        np.diff(rows),
                        word_chars,
                        np.diff(symbols[places]),
                        dup,
                        total(_repeated_words(row, words).astype(np.int64)),
                        size,
                        word_chars / np.maximum(size, 1),
                        np.array(entropy),
                        fallback / np.maximum(solid, 1),
                        np.array(script, dtype=object),
                    ]
                )
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]
                names = [x.split()[0] for x in MEASURES.split(", ")]
                yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, columns, kinds)], ["doc_id", "lang", *names])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(run, f"doc_id long, lang string, {MEASURES}")


def _band(pick) -> Column:
    """The limit of a row's language, else of its script."""
    found = F.lit(None).cast("double")
    for name in sorted(BANDS, key=lambda n: n in SCRIPTS, reverse=True):
        column = F.col("script") if name in SCRIPTS else F.col("lang")
        found = F.when(column == name, F.lit(float(pick(BANDS[name])))).otherwise(found)
    return found


def verdicts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, vocabulary: str, piece_model: str) -> DataFrame:
    """``measures`` with base_failed and kept, one row per row of ``docs``.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed and inside the band. Null texts and empty texts fail the base rule; a null or unknown language is judged
    by its script; null ids and repeated rows are measured like any other; other columns are ignored.
    """
    found = measures(docs, id_col, text_col, lang_col, vocabulary, piece_model)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    least = _band(lambda b: b.entropy[0])
    for i, step in enumerate(ENTROPY_STEPS[1:], 1):
        least = F.when(F.col("n_tokens") >= step, _band(lambda b: b.entropy[i])).otherwise(least)  # noqa: B023
    inside = (
        F.col("chars_per_token").between(_band(lambda b: b.chars_per_token[0]), _band(lambda b: b.chars_per_token[1]))
        & (F.col("entropy") >= least)
        & (F.col("fallback_share") <= _band(lambda b: b.fallback_share))
    )
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)

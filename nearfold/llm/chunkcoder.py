"""Token ids of whole texts, with the tokenizers library asked once per distinct chunk.

A byte-level BPE of this family first splits a text by a pattern in which white
space only ever opens a piece. A cut before white space that follows a visible
character therefore never changes the ids, and most chunks between such cuts
(" word") repeat. The library encodes each distinct chunk once; the ids of a text
are the ids of its chunks in order.
"""

from __future__ import annotations

import os

import numpy as np

from nearfold.llm.textbatch import SPACE, hashes, pieces

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b",.;:!?")] = True
CACHE_CHUNKS = 1_000_000
BATCH_BYTES = 1 << 20
CALL_BYTES = 1 << 16


class ChunkCoder:
    """Encodes columns of text. One per Python worker; ``CACHE_CHUNKS`` bounds what it remembers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.id_bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]  # byte-level: a character for a byte
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, chunks: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The library's ids of the chunks, how many each has and where they begin. Plain chunks (white space, then visible
        characters) travel joined, and the ids are told apart by the bytes that they stand for."""
        length = np.array([len(x) for x in chunks], np.int64)
        size = np.zeros(len(chunks), np.int64)
        odd = np.flatnonzero(~plain)
        parts: list[np.ndarray] = []
        order = [odd]
        if len(odd):
            parts = self._library([chunks[i].decode() for i in odd])
            size[odd] = [len(x) for x in parts]
        some = np.flatnonzero(plain)
        order.append(some)
        call = np.cumsum(length[some]) // CALL_BYTES
        for mine in np.split(some, np.flatnonzero(np.diff(call)) + 1) if len(some) else []:
            ids = self._library([b"".join([chunks[i] for i in mine]).decode()])[0]
            done = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum(length[mine])) + 1
            size[mine] = np.diff(done, prepend=0)
            parts.append(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        order = np.concatenate(order)
        at = np.zeros(len(chunks), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return flat, size, at

    def _learn(self, keys: np.ndarray, chunks: list[bytes], plain: np.ndarray) -> None:
        """Adds chunks, whose keys are sorted and new, to the cache."""
        ids, size, at = self._ask(chunks, plain)
        where = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, where, at + len(self.ids))
        self.size = np.insert(self.size, where, size)
        self.keys = np.insert(self.keys, where, keys)
        self.ids = np.concatenate([self.ids, ids])

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        prev, prev2 = np.zeros_like(data), np.zeros_like(data)
        prev[1:], prev2[2:] = data[:-1], data[:-2]
        # a visible ASCII character, or the end of a two-byte one from U+00C0 on: none of these is white space
        visible = (prev > 0x20) & (prev < 0x7F) | (prev >= 0x80) & (prev2 >= 0xC3) & (prev2 <= 0xDF)
        cut = SPACE[data] & visible
        # a letter ends its piece before punctuation; the apostrophe, which may open "'s", is left out
        letter = (prev | 0x20) - 0x61 < 26
        letter |= (prev2 == 0xC3) & (prev >= 0x80) & (prev != 0x97) & (prev != 0xB7)
        start = cut | letter & PUNCTUATION[data]
        ended = np.append(start, False)
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        keys, first, which = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            where = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            new = self.keys[where] != keys
        if len(self.keys) + new.sum() > CACHE_CHUNKS:
            self.clear()
            new[:] = True
        if new.any():
            raw, some = data.tobytes(), first[new]
            chunks = [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())]
            plain = cut[starts[some]] & ended[ends[some]]
            if any(x.encode() in raw for x in self.special):
                plain[:] = False
            self._learn(keys[new], chunks, plain)
        where = np.searchsorted(self.keys, keys)[which]
        size, at = self.size[where], self.at[where]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(at - (stop - size), size) + np.arange(stop[-1])]
        bounds = np.concatenate([[0], stop])[np.searchsorted(starts, offsets)]
        return ids, bounds

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """Yields the ids of row after row (unsigned 32-bit), in the order of the rows."""
        for i, j in pieces(offsets, BATCH_BYTES):
            ids, bounds = self._piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield ids[a:b]


_coders: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    """This worker's coder for the vocabulary file at ``path``."""
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]

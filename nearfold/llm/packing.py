"""Best-fit packing of token runs into sequences under three capacities.

A sequence has room for ``tokens`` tokens, ``documents`` pieces and ``cost`` units of
attention cost (a piece of n tokens attends to itself only and costs n * n). Pieces go
in by falling length; each goes to the open sequence with the least score among those
with room in every respect, else to a new one. The score is the weighted norm of what
would be left ("norm"), or the weighted dot product of the piece and what is left
before ("dot"), each respect as a share of its capacity.

Pieces are dealt to independent groups by a hash of their key, about GROUP_PIECES to a
group, so that one group's state fits in a task; a group wastes at most a
few sequences at its end. Only keys and lengths travel, never the tokens.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfold.llm.chunkcoder import coder
from nearfold.llm.textbatch import utf8
from nearfold.plans.storage import written

GROUP_PIECES = 60_000


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


class Packer:
    """Open sequences by what they have left: left tokens -> (left documents, left cost) -> their numbers."""

    def __init__(self, cap: Capacity):
        if cap.rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {cap.rule}")
        self.cap, self.used = cap, 0
        self.open: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(cap.tokens + 1)]
        self.some = np.zeros(cap.tokens + 1, bool)

    def _score(self, n: int, left: tuple[int, int, int]) -> float:
        cap, item = self.cap, (n, 1, n * n)
        top = (cap.tokens, cap.documents, cap.cost)
        if cap.rule == "norm":
            return sum(w * ((r - v) / c) ** 2 for w, v, r, c in zip(cap.weights, item, left, top))
        return sum(w * v * r / c / c for w, v, r, c in zip(cap.weights, item, left, top))

    def _best(self, n: int) -> tuple[int, int, int] | None:
        best, found = float("inf"), None
        for tokens in np.flatnonzero(self.some[n:]) + n:
            tokens = int(tokens)
            if self._score(n, (tokens, 1 if self.cap.rule == "norm" else 0, n * n if self.cap.rule == "norm" else 0)) > best:
                break  # the other two can only add to it
            for documents, cost in self.open[tokens]:
                if documents >= 1 and cost >= n * n and (s := self._score(n, (tokens, documents, cost))) < best:
                    best, found = s, (tokens, documents, cost)
        return found

    def _take(self, left: tuple[int, int, int], many: int) -> list[int]:
        states = self.open[left[0]]
        held = states[left[1:]]
        took = [held.pop() for _ in range(many)]
        if not held:
            del states[left[1:]]
            self.some[left[0]] = bool(states)
        return took

    def _put(self, left: tuple[int, int, int], bins: list[int]) -> None:
        if left[0] and left[1] and left[2]:
            self.open[left[0]].setdefault(left[1:], []).extend(bins)
            self.some[left[0]] = True

    def add(self, n: int, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Places ``many`` pieces of ``n`` tokens as if one after the other; their sequences and offsets."""
        cap, bins, offsets = self.cap, [], []
        while many:
            left = self._best(n)
            fresh = left is None
            if fresh:
                left = (cap.tokens, cap.documents, cap.cost)
            fit = min(left[0] // n, left[1], left[2] // (n * n))
            if not fit:
                raise ValueError(f"a piece of {n} tokens is over the capacity of an empty sequence")
            each = min(fit, many)
            have = many // each if fresh else len(self.open[left[0]][left[1:]])
            count = max(1, min(have, many // each))
            if fresh:
                mine = list(range(self.used, self.used + count))
                self.used += count
            else:
                mine = self._take(left, count)
            bins += [b for b in mine for _ in range(each)]
            offsets += [cap.tokens - left[0] + i * n for _ in mine for i in range(each)]
            self._put((left[0] - each * n, left[1] - each, left[2] - each * n * n), mine)
            many -= each * count
        return np.array(bins, np.int64), np.array(offsets, np.int64)


def pack(pieces: DataFrame, keys: list[str], length: str, cap: Capacity = Capacity()) -> DataFrame:
    """``pieces`` with sequence_id and offset. Lengths are 1 to ``cap.tokens``; others raise.

    Ties go by the keys. Pieces are dealt to groups by their places in the table, whatever their keys, so nulls and repeated keys
    spread like others. Columns of these two names in the input raise; an empty table gives an empty one.
    """
    clash = {"sequence_id", "offset", "_group"} & set(pieces.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are given by pack")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(length, "descending"), *((k, "ascending") for k in keys)])
        n = table.column(length).to_numpy()
        if len(n) and (n.min() < 1 or n.max() > cap.tokens):
            raise ValueError(f"lengths must be 1 to {cap.tokens}")
        packer, bins, offsets = Packer(cap), [], []
        size, first = np.unique(-n, return_index=True)
        for value, many in zip((-size).tolist(), np.diff(np.append(first, len(n))).tolist()):
            b, o = packer.add(value, many)
            bins.append(b)
            offsets.append(o)
        group = table.column("_group")[0].as_py()
        out = table.drop_columns(["_group"])
        out = out.append_column("sequence_id", pa.array((group << 32) + np.concatenate(bins)))
        return out.append_column("offset", pa.array(np.concatenate(offsets)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_group").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, tokens: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of each whole text and ``end_id``, in runs of
    ``tokens`` where there are more; the first run takes the remainder. A null text is empty."""

    def run(batches):
        encode = coder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode.encode(*utf8(batch.column(1)))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % tokens or tokens
                cuts = [0, *range(first, len(ids) + 1, tokens)]
                for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    row.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, cap: Capacity = Capacity()
) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rows with a null id are packed like others; repeated rows are packed each.
    """
    runs = written(pieces(docs, id_col, text_col, vocabulary, end_id, cap.tokens), "pieces")
    return pack(runs, ["doc_id", "piece"], "length", cap)

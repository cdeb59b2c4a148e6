"""N-gram Jaccard self-join through a token-group matrix.

Documents are sets of word shingles; two are linked when |A n B| / |A u B| >= t = num / den.
The join returns classes of linked documents, not pairs, and loses no link:

1. ``sets``: documents of equal sets are one set from here on.
2. ``rare_tokens``: in any one order of all tokens, linked sets share one of the first
   n - ceil(t * n) + 1 tokens of each. The order puts a fixed share of the hash range first, by the
   number of sets that hold a token, then the other tokens by hash; so only that share has to be
   counted. A token that one set holds cannot link it, and most sets have enough of those to be out at once.
3. ``groups``: a set follows the smallest set of the rare token it shares most such leaders by; the followers of
   one leader, in chunks of at most GROUP_SETS, are a group of similar sets. A group keeps its token union,
   each token with a bit mask of the members that hold it (a row of the token-group matrix).
4. Links. Inside a group, a member is opened if the rest of the union holds enough of it. Across groups, a set queries a
   group if the rare tokens that it shares with the group's leave room for a link (``_across``), the overlap
   with the whole union is asked next, and only groups within that bound are opened. A set asks only groups of larger
   components, so a large group of near copies is not compared all with all.

Every step is a keyed join or aggregate on hashes and ids; aggregates are written before they are joined, so
that Spark can split a hot key. Whole token sets are read for sets that share a rare token with another set, no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfold.llm.textbatch import LOWER, filter_bits, hashes, mix, passing, pieces, shingles, spans, utf8
from nearfold.operators.components import connected_components
from nearfold.plans.storage import scratch, written

COUNTED = 1.5  # the counted share of the hash range, in units of 1 - t: a little more than the rare tokens that are wanted
GROUP_SETS = 63
GROUP_MEAN = 40
GROUP_TOKENS = 150_000
QUERIES_PER_TASK = 256
GROUPS_PER_TASK = 8
_U = np.uint64


def token_sets(column, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z as a-z."""
    data, offsets = utf8(column)
    for i, j in pieces(offsets):
        some = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, rows = spans(some, offsets[i : j + 1] - offsets[i])
        words = hashes(some, starts, ends)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            yield np.unique(shingles(words[a:b], k))


def signatures(docs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """(doc_id, n, fp1, fp2, spare, counted, first): set size, a 128-bit digest of the set, the rare tokens wanted less those in
    the counted share, and the tokens by hash, those of the counted share (``counted`` many) or as many as are wanted."""
    share = _U(min((1 << 64) - 1, int((1 << 64) * COUNTED * (den - num) / den)))

    def run(batches):
        for batch in batches:
            rows, firsts = [[], [], [], [], []], []
            for s in token_sets(batch.column(1), k):
                n, counted = len(s), int(np.searchsorted(s, share))
                wanted = n - -(-num * n // den) + 1 if n else 0
                rows[0].append(n)
                rows[1].append(int(np.add.reduce(mix(s))) - (1 << 63))
                rows[2].append(int(np.add.reduce(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)))) - (1 << 63))
                rows[3].append(wanted - counted)
                rows[4].append(counted)
                firsts.append(s[: max(counted, wanted)])
            yield pa.record_batch(
                [batch.column(0), *(pa.array(r, pa.int64()) for r in rows), _lists(firsts)],
                ["doc_id", "n", "fp1", "fp2", "spare", "counted", "first"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, spare long, counted long, first array<long>")


def rare_tokens(sets: DataFrame) -> DataFrame:
    """(doc_id, sig): the first tokens of each set in the order of the join, but for those that no other set holds."""
    every = sets.select("doc_id", "spare", "counted", F.posexplode("first").alias("place", "sig"))
    often = written(every.groupBy("sig").agg(F.count("*").alias("held")).where("held > 1"), "often")
    shared = every.select("doc_id", "spare", (F.col("place") < F.col("counted")).alias("inside"), "sig").join(often.hint("merge"), "sig")
    one = F.struct("held", "sig")
    each = shared.groupBy("doc_id", "spare").agg(
        F.array_sort(F.collect_list(F.when(F.col("inside"), one))).alias("inside"), F.collect_list(F.when(~F.col("inside"), F.col("sig"))).alias("rest")
    )
    least = F.transform(F.slice("inside", 1, F.greatest(F.col("spare") + F.size("inside"), F.lit(0)).cast("int")), lambda x: x["sig"])
    return each.select("doc_id", F.explode(F.concat(least, "rest")).alias("sig"))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _linked(both: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * both >= num * (a + b - both)


class TokenGroup:
    """One group of at most 64 sets: its token union and, for each token, the members that hold it."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]):
        self.ids = ids
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, member = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        at = np.concatenate([[0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1])
        self.union = tokens[at]
        self.masks = np.bitwise_or.reduceat(_U(1) << member.astype(_U), at)

    def _bits(self, masks: np.ndarray) -> np.ndarray:
        return np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(self.ids)]

    def inner(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked members, two by two. Members of which the others' union holds too little are not compared."""
        masks, count = np.unique(self.masks, return_counts=True)
        bits = self._bits(masks)
        held = bits[bits.sum(axis=1) > 1].astype(np.float64)
        count = count[bits.sum(axis=1) > 1].astype(np.float64)
        opened = np.flatnonzero((den + num) * (count @ held) >= num * (self.sizes + self.sizes.min()))
        some = held[:, opened]
        both = np.rint((some * count[:, None]).T @ some).astype(np.int64)
        size = self.sizes[opened]
        x, y = np.nonzero(np.triu(_linked(both, size[:, None], size[None, :], num, den), 1))
        return self.ids[opened[x]], self.ids[opened[y]]

    def open(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """The members linked with ``query``; none, and no member looked at, if the union's overlap is too small."""
        where = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        hit = where[self.union[where] == query]
        n = len(query)
        if (den + num) * len(hit) < num * (n + int(self.sizes.min())):
            return self.ids[:0]
        both = self._bits(self.masks[hit]).sum(axis=0, dtype=np.int64)
        return self.ids[_linked(both, n, self.sizes, num, den)]


def _sets_of(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.asarray(x.values).view(_U) for x in table.column(name).combine_chunks()]


def _passing(batches, bits: np.ndarray):
    """The rows whose id, in the first column, passes the filter."""
    for batch in batches:
        some = passing(batch.column(0).to_numpy(), bits)
        if some.any():
            yield batch.filter(pa.array(some))


def classes(docs: DataFrame, id_col: str, text_col: str, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Links: Jaccard similarity of the sets of ``k``-word shingles >= num / den, A-Z as a-z; a
    text of fewer words is one shingle; null or wordless texts have an empty set and link with
    nothing. component_id is the smallest id reachable by links, the row's own included. Rows
    with a null id take part in nothing and come back with component_id null. An id names one
    text; repeated rows come back as often as they occur. Other columns are ignored, whatever
    their names, and an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession) as kept:
        sig = written(signatures(base, num, den, k), "signatures")
        place = kept(_places(base, sig, num, den, k), "places")
        sizes = kept(sig.select("doc_id", "n"), "sizes")
    return sizes.join(place.hint("merge"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, sig) of tokens that two or more sets have, with the smallest of these as ``lo``."""
    lists = rows.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    return rows.join(written(lists.select("sig", "lo"), "lists").hint("merge"), "sig")


def _numbers(count: str):
    """The numbers below a count, in two steps, so that no row holds a long list."""
    return lambda df, name: (
        df.withColumn("_far", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / 4096))))
        .withColumn(name, F.explode(F.sequence(F.col("_far") * 4096, F.least(F.col("_far") * 4096 + 4095, F.col(count) - 1))))
        .drop("_far")
    )


def _places(base: DataFrame, sig: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """(doc_id, component) of every document that is linked with another."""
    named = sig.where("doc_id is not null and n > 0")
    digest = ["n", "fp1", "fp2"]
    sets = named.groupBy(*digest).agg(
        F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("spare").alias("spare"),
        F.first("counted").alias("counted"), F.first("first").alias("first"),
    )
    sets = written(sets, "sets")
    first = sets.where("doc_id < last").select(*digest, F.col("doc_id").alias("rep"))
    copies = written(named.select("doc_id", *digest).join(first.hint("merge"), digest).where("doc_id <> rep").select("doc_id", "rep"), "copies")
    some = written(_shared(written(rare_tokens(sets), "rare")), "shared")

    votes = some.groupBy("doc_id", "lo").agg(F.count("*").alias("n"))
    leader = votes.groupBy("doc_id").agg(F.max_by("lo", F.struct("n", -F.col("lo"))).alias("leader"))
    leader = written(leader.join(sets.select("doc_id", "n").hint("merge"), "doc_id"), "leaders")
    counts = leader.groupBy("leader").agg(
        F.greatest(F.ceil(F.count("*") / GROUP_MEAN), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("chunks"), F.max("doc_id").alias("last")
    )
    counts = written(counts.where("leader <> last or chunks > 1"), "counts")
    led = leader.join(counts.drop("last").hint("merge"), "leader", "left").select(
        "doc_id", "n", "leader", F.pmod(F.xxhash64("doc_id"), F.coalesce("chunks", F.lit(1))).alias("chunk")
    )
    led = written(led, "led")
    role = led.join(counts.select(F.col("leader").alias("doc_id"), "chunks").hint("merge"), "doc_id", "left")  # its own group; the groups that it leads
    bits = filter_bits(leader, "doc_id")

    def sets_of(batches):
        for batch in _passing(batches, bits):
            found = [s.view(np.int64) for s in token_sets(batch.column(1), k)]
            yield pa.record_batch([batch.column(0), _lists(found)], ["doc_id", "tokens"])

    tokens = base.select("doc_id", "text").where("doc_id is not null").mapInArrow(sets_of, "doc_id long, tokens array<long>")
    tokens = written(tokens.join(role.hint("merge"), "doc_id"), "tokens")  # grows with the documents: never a broadcast

    # inside each group; the leader's set is a member of each of its chunks
    leaders = _numbers("chunks")(tokens.where("chunks is not null").select("doc_id", "tokens", "chunks"), "chunk")
    leaders = leaders.select(F.col("doc_id").alias("leader"), "chunk", "doc_id", "tokens")
    members = tokens.where("doc_id <> leader").select("leader", "chunk", "doc_id", "tokens")

    def inside(table: pa.Table) -> pa.Table:
        ids, sets_ = table.column("doc_id").to_numpy(), _sets_of(table, "tokens")
        leads = ids == table.column("leader")[0].as_py()
        lead, rest = np.flatnonzero(leads)[:1], np.flatnonzero(~leads)
        found = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(rest), GROUP_SETS):  # an uneven deal may pass the size; the leader joins each part
            rows = np.concatenate([lead, rest[i : i + GROUP_SETS]])
            found.append(np.stack(TokenGroup(ids[rows], [sets_[r] for r in rows]).inner(num, den), 1))
        pairs = _forest(np.concatenate(found))
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    links = leaders.unionByName(members).groupBy("leader", "chunk").applyInArrow(inside, "a long, b long")
    links = written(links, "links")
    near = connected_components(links, "a", "b")
    placed = written(
        some.select("sig", "doc_id")
        .join(led.hint("merge"), "doc_id")
        .join(near.hint("merge"), F.col("doc_id") == F.col("node"), "left")
        .select("sig", "doc_id", "n", "leader", "chunk", F.coalesce("component", "doc_id").alias("comp")),
        "placed",
    )
    more = _across(placed, tokens, num, den)
    ends = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    every = connected_components(links.unionByName(more).unionByName(ends), "a", "b")
    return every.select(F.col("node").alias("doc_id"), "component")


def _forest(pairs: np.ndarray) -> np.ndarray:
    """A star per component of the pairs: as many rows as ids at most, instead of all pairs of a group."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([(x, find(x)) for x in root if find(x) != x], np.int64).reshape(-1, 2)


def _block():
    return F.floor(F.col("chunk") / GROUPS_PER_TASK)


def _room(hits, n, least, most, num: int, den: int):
    """Whether a set of size ``n`` that shares ``hits`` rare tokens with a group of sets of ``least`` to ``most`` tokens may be linked with one.

    The rare tokens of the set or of the member, whichever end first, are all counted, so at most hits + t * (the larger size)
    tokens are in both; a link needs t / (1 + t) of the two sizes. The bound is least for the member nearest to a size at its limit.
    """
    room = (num + den) * den * hits
    larger = (most >= n) & (den * n >= num * least) & (room >= num * F.greatest(den * n - num * most, F.lit(0)))
    smaller = (least <= n) & (den * most >= num * n) & (room >= num * F.greatest(den * least - num * n, F.lit(0)))
    return larger | smaller


def _across(placed: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Links between sets that share a rare token but not a component.

    Of two such sets the one whose component ranks lower, by size and then by id, queries the group of the other: a
    large component is asked by what is left outside of it and asks nothing itself. Groups of one leader are asked
    GROUPS_PER_TASK at a time, each by its own union.
    """
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    sizes = placed.select("comp", "doc_id").distinct().groupBy("comp").agg(F.count("*").alias("size"))
    open_ = placed.join(written(mixed, "mixed").hint("merge"), "sig").join(written(sizes, "comps").hint("merge"), "comp")
    open_ = written(open_.withColumn("rank", F.struct("size", "comp")).withColumn("block", _block()), "open")
    asks = open_.select("sig", "rank", "n", F.col("doc_id").alias("query"), F.col("leader").alias("own"))
    # the sizes are those of the members that hold the token: of two linked sets each is among them for every token they share
    groups = open_.groupBy("sig", "leader", "block").agg(F.max("rank").alias("top"), F.min("n").alias("least"), F.max("n").alias("most"))
    groups = written(groups, "groups")
    near = (den * F.col("n") >= num * F.col("least")) & (den * F.col("most") >= num * F.col("n"))
    others = asks.join(groups.hint("merge"), "sig").where("own <> leader and rank < top").where(near)
    others = others.groupBy("query", "n", "leader", "block").agg(F.count("*").alias("hits"), F.min("least").alias("least"), F.max("most").alias("most"))
    others = others.where(_room(F.col("hits"), F.col("n"), F.col("least"), F.col("most"), num, den)).select("query", "leader", "block")
    # followers of one leader share many tokens: they meet once by the leader instead of once for each token
    tops = written(groups.groupBy("leader", "block").agg(F.max("top").alias("top")), "tops")
    family = written(asks.select("own", "query", "rank").distinct(), "family")
    family = family.join(tops.hint("merge"), F.col("own") == F.col("leader")).where("rank < top").select("query", "leader", "block")
    wanted = others.unionByName(family).distinct()
    wanted = written(wanted, "wanted")
    load = written(wanted.groupBy("leader", "block").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).alias("parts")), "load")
    asking = wanted.join(load.hint("merge"), ["leader", "block"]).select(
        "leader", "block", F.pmod(F.xxhash64("query"), F.col("parts")).alias("part"), "query"
    )
    bits = filter_bits(wanted, "query")
    asked = tokens.select(F.col("doc_id").alias("query"), F.col("tokens").alias("asked"))
    asked = asked.mapInArrow(lambda batches: _passing(batches, bits), "query long, asked array<long>")
    asking = asking.join(asked.hint("merge"), "query")
    groups = tokens.withColumn("block", _block()).join(load.hint("merge"), ["leader", "block"])
    groups = _numbers("parts")(groups, "part").select("leader", "block", "part", "chunk", "doc_id", "tokens")

    def opened(group: pa.Table, queries: pa.Table) -> pa.Table:
        a, b = [], []
        if group.num_rows and queries.num_rows:
            group = group.sort_by("chunk")
            ids, sets = group.column("doc_id").to_numpy(), _sets_of(group, "tokens")
            held = [
                TokenGroup(ids[i : i + GROUP_SETS + 1], sets[i : i + GROUP_SETS + 1])
                for i in range(0, len(ids), GROUP_SETS + 1)
            ]
            for query, tokens_ in zip(queries.column("query").to_pylist(), _sets_of(queries, "asked")):
                for g in held:
                    for other in g.open(tokens_, num, den).tolist():
                        if other != query:
                            a.append(query)
                            b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = (
        groups.groupBy("leader", "block", "part")
        .cogroup(asking.groupBy("leader", "block", "part"))
        .applyInArrow(opened, "a long, b long")
    )
    return written(found.distinct(), "across")

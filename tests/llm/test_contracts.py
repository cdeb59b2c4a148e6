"""The ten queries against brute force over the smallest tables, and their operators on awkward rows."""

import base64
import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from nearfold.llm import decontam, fertility, ngram_join, packing, queries, templates, token_files, token_rollup, units, url_lists, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LONG = "one two three four five six seven eight nine ten " * 3000
AWKWARD = [
    (1, "a b c d e f g h", "x", 0),
    (2, None, None, 0),
    (3, "", "en", 0),
    (4, " \n\t ", "en", 0),
    (None, "a b c d e f g h", "en", 0),
    (5, "A b c d e f g h", "en", 0),
    (5, "A b c d e f g h", "en", 0),
    (6, LONG, "en", 0),
    (7, "é ü 日本語 \x00 x", None, 0),
]
SCHEMA = "doc_id long, text string, lang string, start int"


@pytest.fixture(scope="module")
def docs(sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    return dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.BYTE_BPE)


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(texts, k, num, den):
    sets = {d: shingle_set(t, k) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_op1(spark, sf, docs):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_jaccard_join(spark, sf).collect()}
    assert found == brute_components(docs, 3, 90, 100)


@pytest.mark.parametrize(("k", "num", "seed"), [(1, 50, 0), (1, 80, 1), (2, 90, 2)])
def test_join_against_brute_force(spark, k, num, seed):
    rng = np.random.default_rng(seed)
    texts, base = {}, [rng.integers(0, 400, int(n)) for n in rng.integers(1, 40, 12)]
    for d in range(260):
        words = base[int(rng.integers(len(base)))].copy()
        flip = rng.random(len(words)) < rng.choice([0, 0.03, 0.1, 0.3])
        words[flip] = rng.integers(0, 400, int(flip.sum()))
        texts[d * 3] = " ".join(map(str, words))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df, "doc_id", "text", k, num, 100).collect()}
    assert found == brute_components(texts, k, num, 100)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [str(x) for x in rng.integers(0, 10**6, 120)]
    texts = {}
    for d in range(400):
        words = list(base)
        for i in rng.integers(0, 120, int(rng.integers(0, 12))):
            words[int(i)] = f"w{d}"
        texts[d] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df, "doc_id", "text", 1, 85, 100).collect()}
    assert found == brute_components(texts, 1, 85, 100)


def test_rare_tokens_keep_every_link(spark):
    """In any order of the tokens, linked sets share one of their first tokens, and the bound on a group leaves them room."""
    rng, rows = np.random.default_rng(3), []
    for num in (50, 80, 90):
        for _ in range(300):
            n = int(rng.integers(1, 120))
            a = set(rng.integers(0, 1000, n).tolist())
            b = set(a)
            for x in list(a)[: int(rng.integers(0, max(1, n // 4) + 1))]:
                b.discard(x)
                if rng.random() < 0.5:
                    b.add(int(rng.integers(0, 1000)))
            if b and 100 * len(a & b) >= num * len(a | b):
                order = rng.permutation(1000)
                first = [set(sorted(s, key=lambda x: order[x])[: len(s) - -(-num * len(s) // 100) + 1]) for s in (a, b)]
                rows.append((num, len(first[0] & first[1]), len(a), len(b)))
    assert min(r[1] for r in rows) > 0
    df = spark.createDataFrame(rows, "num long, hits long, n long, m long")
    col = ngram_join.F.col
    for num in (50, 80, 90):
        some = df.where(col("num") == num)
        assert some.where(~ngram_join._room(col("hits"), col("n"), col("m"), col("m"), num, 100)).isEmpty()
        assert some.where(~ngram_join._room(col("hits"), col("n"), col("m") - 5, col("m") + 9, num, 100)).isEmpty()
    assert spark.sql("select 1 hits, 100 n, 100 m").where(ngram_join._room(col("hits"), col("n"), col("m"), col("m"), 80, 100)).isEmpty()


def test_group_opens_members_within_the_bound():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 150, int(n))).astype(np.uint64) for n in rng.integers(20, 90, 30)]
    sets += [np.setdiff1d(s, s[:2]) for s in sets[:10]]
    group = ngram_join.TokenGroup(np.arange(40), sets)
    linked = {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(*(x.tolist() for x in group.inner(80, 100)))) == linked and len(linked) >= 10
    for i in range(40):
        assert set(group.open(sets[i], 80, 100).tolist()) == {j for j in range(40) if i == j or tuple(sorted((i, j))) in linked}


def test_join_awkward_rows(awkward, empty):
    rows = ngram_join.classes(awkward, "doc_id", "text", 3, 90, 100).collect()
    found = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    expected = collections.Counter({(1, 6, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 0, 4): 1, (None, 6, None): 1, (5, 6, 1): 2, (6, 10, 6): 1, (7, 2, 7): 1})
    assert found == expected
    assert ngram_join.classes(empty, "doc_id", "text").collect() == []


def expected_tokens(library, docs, end):
    start, out = 0, {}
    for d in sorted(docs):
        ids = [*library.encode(docs[d] or "", add_special_tokens=False).ids, end]
        out[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_op2(spark, sf, docs, library):
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, sf).collect()}
    assert found == expected_tokens(library, docs, 0)


def test_token_files_random_access_and_damage(spark, awkward, empty, library):
    manifest = token_files.write(awkward, "doc_id", "text", queries.BYTE_BPE, end_id=0)
    assert [r.n_tokens for r in token_files.read(manifest).where("doc_id is null").collect()] == [9]
    assert token_files.read(manifest).count() == len(AWKWARD)
    asked = spark.createDataFrame([(5,), (6,), (99,)], "id long")
    got = sorted((r.doc_id, len(r.ids)) for r in token_files.lookup(manifest, asked).collect())
    long = len(library.encode(LONG, add_special_tokens=False).ids) + 1
    assert got == [(5, 9), (5, 9), (6, long)]
    path = manifest.first().path
    import zstandard

    raw = bytearray(open(path.removeprefix("file://"), "rb").read())
    assert zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read(2)
    reader = token_files.FrameReader(path)
    raw[int(reader.at[len(reader.table) - 1]) + 12] ^= 0xFF
    open(path.removeprefix("file://"), "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017  damage shows in the decoder or in the checksum
        list(token_files.FrameReader(path).frames(range(len(reader.table))))
    assert token_files.read(token_files.write(empty, "doc_id", "text", queries.BYTE_BPE)).collect() == []


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    held = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(held) - len(set(held)), len(covered)


def brute_kept(text, lang, library, piece_ids):
    """The verdict on one text of a known language, from its definition."""
    b, words = brute_quality(text), WORD.findall(text or "")
    if b[0] < 50 or 100 * b[4] > 50 * b[0]:
        return False
    ids = library.encode(text, add_special_tokens=False).ids
    p = np.array(list(collections.Counter(ids).values())) / len(ids)
    spelt = sum(sum(3 <= i <= 258 for i in piece_ids(w)) for w in words) / (len(" ".join(words).encode()) - len(words) + 1)
    band, step = fertility.BANDS[lang], [x <= len(ids) for x in fertility.ENTROPY_STEPS].count(True) - 1
    low, high = band.chars_per_token
    return low <= b[1] / len(ids) <= high and -(p * np.log2(p)).sum() >= band.entropy[step] and spelt <= band.fallback_share


def test_op3(spark, sf, docs, library):
    import functools

    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=str(queries.PIECES))
    piece_ids = functools.cache(lambda w: pieces.encode(w))
    t = pq.read_table(f"{sf}/documents.parquet")
    langs = dict(zip(t.column("doc_id").to_pylist(), t.column("lang").to_pylist()))
    rows = {r.doc_id: r for r in queries.op3_fertility_rules(spark, sf).collect()}
    assert rows.keys() == docs.keys()
    for d, text in docs.items():
        r, b = rows[d], brute_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, d
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)
        count = collections.Counter(ids := library.encode(text or "", add_special_tokens=False).ids)
        assert r.n_tokens == len(ids)
        if ids:
            p = np.array(list(count.values())) / len(ids)
            assert abs(r.entropy + (p * np.log2(p)).sum()) < 1e-9
        assert abs(r.chars_per_token - b[1] / max(len(ids), 1)) < 1e-9
        words = WORD.findall(text or "")
        spelt = sum(sum(3 <= i <= 258 for i in piece_ids(w)) for w in words)
        assert abs(r.fallback_share - spelt / max(1, len(" ".join(words).encode()) - len(words) + 1)) < 1e-9, d
        band = fertility.BANDS[langs[d]]
        step = [x <= len(ids) for x in fertility.ENTROPY_STEPS].count(True) - 1
        inside = band.chars_per_token[0] <= r.chars_per_token <= band.chars_per_token[1] and r.entropy >= band.entropy[step] and r.fallback_share <= band.fallback_share
        assert r.kept == (inside and not r.base_failed)


def test_op3_against_labels(spark, sf):
    root = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "quality")
    found = queries.op3_fertility_rules(spark, root).join(labels, "doc_id").where("not base_failed")
    share = {r.quality: r.kept for r in found.groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "kept").collect()}
    kept = {r.quality: r["count"] for r in found.where("kept").groupBy("quality").count().collect()}
    assert kept[1] / share[1] > 0.99
    assert kept.get(0, 0) / share[0] < 0.2


def test_quality_awkward_rows(awkward, empty):
    args = ("doc_id", "text", "lang", queries.BYTE_BPE, queries.PIECES)
    rows = fertility.verdicts(awkward, *args).collect()
    assert len(rows) == len(AWKWARD) and not any(r.kept for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_words == by[3].n_tokens == 0 and by[7].fallback_share > 0 and by[6].base_failed
    assert fertility.verdicts(empty, *args).collect() == []


def check_packing(rows, tokens):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= tokens
    return len(bins)


def test_op4(spark, sf, docs, library):
    rows = queries.op4_best_fit_packing(spark, sf).collect()
    bins = check_packing(rows, 1024)
    total = 0
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by.keys() == docs.keys()
    for d, text in docs.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        held = sorted(by[d], key=lambda r: r.piece)
        assert [r.piece for r in held] == list(range(len(held))) and len(held) == -(-len(ids) // 1024)
        at = 0
        for r in held:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.piece == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    assert bins <= 1.01 * -(-total // 1024) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_under_every_capacity(spark, rule):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(np.minimum(rng.geometric(0.02, 3000), 200))]
    cap = packing.Capacity(tokens=256, documents=5, cost=20_000 + 200 * 200, weights=(1.0, 0.5, 0.5), rule=rule)
    found = packing.pack(spark.createDataFrame(rows, "id long, n long"), ["id"], "n", cap).collect()
    assert sorted((r.id, r.n) for r in found) == rows
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append(r.n)
    assert all(sum(b) <= 256 and len(b) <= 5 and sum(n * n for n in b) <= cap.cost for b in bins.values())


def test_packing_is_best_fit_one_piece_at_a_time():
    rng = np.random.default_rng(2)
    cap = packing.Capacity(tokens=100, documents=4, cost=6000 + 10_000)
    sizes = sorted(rng.integers(1, 100, 400).tolist(), reverse=True)
    packer, bins = packing.Packer(cap), []
    for n in sizes:
        packer.add(n, 1)
        best = min(
            ((packer._score(n, (b[0], b[1], b[2])), i) for i, b in enumerate(bins) if b[0] >= n and b[1] and b[2] >= n * n),
            default=None,
        )
        if best is None:
            bins.append([cap.tokens, cap.documents, cap.cost])
            best = (0, len(bins) - 1)
        b = bins[best[1]]
        b[0], b[1], b[2] = b[0] - n, b[1] - 1, b[2] - n * n
    grouped = packing.Packer(cap)
    for n, many in sorted(collections.Counter(sizes).items(), reverse=True):
        grouped.add(n, many)
    assert packer.used == grouped.used == len(bins)


def test_pieces_of_one_key_are_dealt_to_all_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    pieces = spark.range(2000).selectExpr("if(id % 3 = 0, id, null) as doc_id", "0 as piece", "id % 900 + 1 as length")
    out = packing.pack(pieces, ["doc_id", "piece"], "length").collect()
    assert len(out) == 2000
    sizes = collections.Counter(r.sequence_id >> 32 for r in out)
    assert len(sizes) == 20 and max(sizes.values()) < 200
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for some in held.values():
        some.sort()
        assert [o for o, _ in some] == [sum(n for _, n in some[:i]) for i in range(len(some))] and sum(n for _, n in some) <= 1024


def test_packing_awkward_rows(spark, awkward, empty):
    rows = packing.pack_documents(awkward, "doc_id", "text", queries.BYTE_BPE, 2).collect()
    check_packing(rows, 1024)
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0)[5] == 2
    assert packing.pack_documents(empty, "doc_id", "text", queries.BYTE_BPE, 2).collect() == []
    with pytest.raises(ValueError, match="given by pack"):
        packing.pack(awkward.withColumnRenamed("start", "offset"), ["doc_id"], "offset")


def test_op5(spark, sf, docs, library):
    t = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    seen, expected = set(), collections.defaultdict(lambda: [0, 0])
    for r in sorted(t, key=lambda r: r["doc_id"]):
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        if r["text"] in seen:
            continue
        seen.add(r["text"])
        for version, more in (("byte_bpe_50k/1", 0), ("byte_bpe_50k/2", 1)):
            key = (r["source"], r["lang"], version)
            expected[key][0] += 1
            expected[key][1] += n + more
    found = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in queries.op5_token_rollups(spark, sf).collect()}
    assert found == expected


def test_rollup_commits_once(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("s", "en", "v", 5), ("s", None, "v", 7), ("s", "en", "v", None)], "source string, lang string, tokenizer_version string, n_tokens long")
    assert rollup.totals().collect() == []
    assert rollup.commit("a", token_rollup.inserts(rows))
    assert not rollup.commit("a", token_rollup.inserts(rows.limit(1)))
    assert rollup.commit("none", token_rollup.inserts(rows.limit(0)))
    total = lambda: sorted(((r.lang or "", r.n_docs, r.n_tokens) for r in rollup.totals().collect()))
    assert total() == [("", 1, 7), ("en", 2, 5)]
    for _ in range(2):  # a retry
        rollup.compact("c1")
        assert total() == [("", 1, 7), ("en", 2, 5)]
    assert not rollup.commit("a", token_rollup.inserts(rows))
    assert rollup.commit("b", token_rollup.deletes(rows.where("lang is null")))
    assert rollup.commit("r", token_rollup.revisions(rows.where("n_tokens = 5").withColumn("old_tokens", rows.n_tokens - 2)))
    for _ in range(2):
        rollup.compact("c2")
        assert total() == [("en", 2, 7)]
    for batch in ("a", "b", "c1", "none", "r", "c2"):
        assert not rollup.commit(batch, token_rollup.inserts(rows))
    (tmp_path / "r" / "batch_id=late").mkdir()  # a job that did not end
    assert rollup.commit("late", token_rollup.inserts(rows.limit(1))) and total() == [("en", 3, 12)]


def test_counts_of_null_and_repeated_ids(spark, awkward, empty, library):
    rows = token_rollup.counts(awkward, "doc_id", "text", queries.BYTE_BPE, ("lang", "start"))
    found = collections.Counter((r.doc_id, r.n_tokens, r.lang, r.start) for r in rows.collect())
    assert found == collections.Counter((d, len(library.encode(t or "", add_special_tokens=False).ids), lang, str(k)) for d, t, lang, k in AWKWARD)
    assert token_rollup.counts(empty, "doc_id", "text", queries.BYTE_BPE, ()).collect() == []


def test_op5_on_awkward_rows(spark, tmp_path, library):
    schema = "doc_id long, text string, source string, lang string"
    rows = [(1, "a b", "x", "en"), (1, "a b", "x", "en"), (None, "c d e", "y", None), (None, "a b", "x", "en"), (3, None, "x", "en"), (4, "a b", None, "en")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in queries.op5_token_rollups(spark, str(tmp_path)).collect()}
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    expected = {}
    for version, more in (("byte_bpe_50k/1", 0), ("byte_bpe_50k/2", 1)):  # ids 1, null and 3 stay; the null id and 4 repeat the text of 1
        expected["x", "en", version] = (3, 2 * (n("a b") + more) + more)
        expected["y", None, version] = (1, n("c d e") + more)
    assert found == expected


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_op6(spark, sf, folder):
    import duckdb

    where, db = os.path.join(os.path.dirname(sf), folder), duckdb.connect()
    db.sql(f"create view pages as select * from '{where}/pages.parquet'")
    rows = db.sql(queries.OP6_SQL).fetchall()
    found = [tuple(r) for r in queries.op6_temporal_url_lists(spark, where).collect()]
    assert sorted(found) == sorted(rows)
    assert {r[-1] for r in rows} >= {"block", "pass"} and ("allow" in {r[-1] for r in rows} or folder == "sf0.001")


def test_url_lists_from_pages_with_nulls(spark, tmp_path):
    rows = [(None, "http://a.example.com/x", "y"), (1, None, None), (2, "", ""), (3, "no host", None), (4, "http://a.example.com/x", "y"), (4, "http://a.example.com/x", "y")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op6_temporal_url_lists(spark, str(tmp_path)).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.decision) for r in found if not r.host) == [(False, 1, "pass"), (False, 2, "pass"), (False, 3, "pass")]
    assert len(found) == 6 and [r.decision for r in found if r.page_id is None] == ["pass"]


def test_url_lists_at_the_edges(spark):
    from datetime import date

    day = lambda n: date(2024, 1, n)
    entries = spark.createDataFrame(
        [
            ("l", "block", "bad.com", day(2), True),
            ("l", "block", "bad.com", day(2), False),
            ("l", "block", "bad.com", day(3), True),
            ("l", "block", "bad.com", day(5), False),
            ("l", "block", "bad.com", day(9), True),
            ("l", "allow", "ok.bad.com", day(1), True),
            ("l", "block", "gone.com", day(1), False),
            ("l", "block", None, day(1), True),
        ],
        "list string, verdict string, key string, day date, added boolean",
    )
    captures = spark.createDataFrame(
        [
            (1, "http://a.BAD.com/x", day(1)),
            (2, "http://a.bad.com:8080/x", day(2)),
            (3, "https://u@a.bad.com", day(4)),
            (4, "http://a.bad.com/", day(5)),
            (5, "http://bad.com/", day(9)),
            (6, "http://ok.bad.com/", day(9)),
            (7, "no url", day(9)),
            (8, None, day(9)),
            (9, "http://bad.com/", None),
            (10, "http://gone.com/", day(9)),
            (10, "http://gone.com/", day(9)),
        ],
        "id long, url string, day date",
    )
    rows = url_lists.evaluate(captures, "id", "url", "day", url_lists.intervals(entries)).collect()
    assert sorted((r.capture_id, r.decision) for r in rows) == [
        (1, "pass"), (2, "block"), (3, "block"), (4, "pass"), (5, "block"), (6, "allow"),
        (7, "pass"), (8, "pass"), (9, "pass"), (10, "pass"), (10, "pass"),
    ]
    assert url_lists.evaluate(captures.limit(0), "id", "url", "day", url_lists.intervals(entries.limit(0))).collect() == []


def test_url_lists_with_long_urls_and_clashing_columns(spark):
    from datetime import date

    day = lambda n: date(2024, 1, n)
    long = "x" * 300_000
    entries = spark.createDataFrame([("a", "block", "bad.com", day(1), True, "z", 1)], "list string, verdict string, key string, day date, added boolean, decision string, start int")
    captures = spark.createDataFrame(
        [(1, f"http://bad.com/{long}", day(2), "k", "allow", 7), (2, f"http://{long}.bad.com/", day(2), "k", "allow", 7), (3, f"http://{long}", day(2), None, None, None), (4, long, day(2), "bad.com", "block", 7)],
        "id long, url string, day date, key string, verdict string, capture_id int",
    )
    rows = url_lists.evaluate(captures, "id", "url", "day", url_lists.intervals(entries)).collect()
    assert sorted((r.capture_id, r.decision) for r in rows) == [(1, "block"), (2, "block"), (3, "pass"), (4, "pass")]


def test_op7(spark, sf, docs):
    """Every row found is within reach and at the right distance; exact passages are all found, near ones to nine tenths at least."""
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    rows = {(r.doc_id, r.item_id): r for r in queries.op7_cgk_decontamination(spark, sf).collect()}
    targets = {x["item_id"]: [word_hash(w) for w in WORD.findall(x["text"].translate(LOWER))] for x in items}
    near, exact = {}, set()
    for d, text in docs.items():
        words = np.array([word_hash(w) for w in WORD.findall((text or "").translate(LOWER))], np.uint64)
        held = set(words.tolist())
        for i, target in targets.items():
            allowed = len(target) // 10
            if len(words) and sum(w not in held for w in target) <= allowed:
                distance = brute_distance_at_most(words, target)
                if distance <= allowed:
                    near[d, i] = distance
                if distance == 0:
                    exact.add((d, i))
    assert exact and exact <= rows.keys() <= near.keys()
    assert all(rows[k].distance == 0 for k in exact) and all(rows[k].distance >= near[k] for k in rows)
    assert len(rows) >= 0.9 * len(near)


def brute_distance_at_most(text, item):
    """The least edit distance of ``item`` to a run of ``text``, a column of the table at a time (Sellers, 1980)."""
    cost = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        step = np.append(i, np.minimum(cost[:-1] + (text != np.uint64(w)), cost[1:] + 1))
        cost = np.minimum.accumulate(step - ramp) + ramp
    return int(cost.min())


def brute_distance(text, item):
    prev = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(prev[j - 1] + (t != w), prev[j] + 1, now[j - 1] + 1))
        prev = now
    return min(prev)


def test_best_match_is_the_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(300):
        text, item = rng.integers(0, 5, int(rng.integers(0, 25))), rng.integers(0, 5, int(rng.integers(1, 12)))
        distance, a, b = decontam.best_match(text.astype(np.uint64), item.astype(np.uint64))
        assert distance == brute_distance(text.tolist(), item.tolist())
        whole = [[max(i, j) if not i or not j else 0 for j in range(b - a + 1)] for i in range(len(item) + 1)]
        for i in range(1, len(item) + 1):
            for j in range(1, b - a + 1):
                whole[i][j] = min(whole[i - 1][j - 1] + (item[i - 1] != text[a + j - 1]), whole[i - 1][j] + 1, whole[i][j - 1] + 1)
        assert whole[-1][-1] == distance


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_decontamination_recall(spark, edits):
    rng = np.random.default_rng(edits)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    draw = lambda n: vocabulary[np.minimum(rng.zipf(1.3, n), 3000) - 1].tolist()
    items = [(i, draw(int(rng.integers(20, 60)))) for i in range(150)]
    docs = []
    for i, words in items:
        words = list(words)
        for _ in range(edits):
            p, kind = int(rng.integers(len(words))), int(rng.integers(3))
            words[p : p + (kind != 1)] = [] if kind == 2 else ["edit"]
        docs.append((i, " ".join(draw(int(rng.integers(0, 200))) + words + draw(30))))
    docs += [(1000 + i, " ".join(draw(300))) for i in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows = decontam.matches(d, "doc_id", "text", b, "item_id", "text").collect()
    right = {r.doc_id for r in rows if r.doc_id == r.item_id}
    assert all(r.doc_id == r.item_id for r in rows)
    assert len(right) >= (150 if edits == 0 else 0.95 * 150)


def test_decontamination_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame([(1, "c d e"), (2, None), (3, " "), (4, "zz"), (5, "X")], "item_id long, text string")
    rows = decontam.matches(awkward, "doc_id", "text", items, "item_id", "text").collect()
    found = collections.Counter((r.doc_id, r.item_id) for r in rows)
    assert found == {(1, 1): 1, (None, 1): 1, (5, 1): 2, (7, 5): 1}
    for d, i in ((empty, items), (awkward, items.limit(0))):
        assert decontam.matches(d, "doc_id", "text", i, "item_id", "text").collect() == []


def test_op8(spark, sf):
    pages = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    first = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        first.setdefault(p["html"] or "", p["page_id"])
    expected = set()
    for p in pages:
        data = (p["html"] or "").encode()
        other = first[p["html"] or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.add((p["page_id"], len(data), digest, "response" if other == p["page_id"] else "revisit", None if other == p["page_id"] else other))
    rows = [tuple(r) for r in queries.op8_warc_index(spark, sf).collect()]
    assert len(rows) == len(pages) and set(rows) == expected


def test_warc_awkward_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "BATCH_ROWS", 4)  # the captures of a hot key come in several batches
    rows = [(3, "http://b.a.com/x", "é"), (1, "http://b.a.com/x", "é"), (2, None, None), (None, "http://a.com/", "é"), (4, "http://b.a.com/x", ""), (5, "HTTP://A.com:80", "new\r\n\r\nline"), (5, "HTTP://A.com:80", "new\r\n\r\nline")]
    rows += [(100 + i, "http://hot.com/", f"p{i}") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.build_index(warc.write(pages, "page_id", "url", "html"))
    every = warc.lookup(index, warc.keys_of(pages, "url")).collect()
    found = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in every)
    expected = [(3, 2, "revisit", 1), (1, 2, "response", None), (2, 0, "response", None), (None, 2, "revisit", 1), (4, 0, "revisit", 2), (5, 11, "response", None), (5, 11, "response", None)]
    assert found == collections.Counter(expected + [(100 + i, 2, "response", None) for i in range(9)])
    one = warc.lookup(index, spark.createDataFrame([("com,a,b)/x",), ("com,none)/",)], "surt string"))
    assert sorted(r.page_id for r in one.collect()) == [1, 3, 4]
    none = warc.build_index(warc.write(pages.limit(0), "page_id", "url", "html"))
    assert warc.lookup(none, warc.keys_of(pages, "url")).collect() == []
    for url, key in (("http://www.A.com:8080/p?q#f", "com,a,www:8080)/p?q"), ("x", "x"), (None, ""), ("http://[bad", "http://[bad")):
        assert warc.surt(url) == key


def test_warc_long_payloads_and_clashing_columns(spark):
    long = "é<p>\n" * 1_000_000
    rows = [(1, "http://a.com/1", long, "d", 5, "response"), (2, "http://a.com/2", long, None, None, "revisit"), (3, "http://a.com/" + "q" * 100_000, "short", "d", 0, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, offset long, record_type string")
    index = warc.build_index(warc.write(pages, "page_id", "url", "html"))
    found = {r.page_id: r for r in warc.lookup(index, warc.keys_of(pages, "url")).collect()}
    digest = base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()
    assert {d: (r.payload_bytes, r.record_type, r.refers_to) for d, r in found.items()} == {1: (6_000_000, "response", None), 2: (6_000_000, "revisit", 1), 3: (5, "response", None)}
    assert found[1].payload_digest == found[2].payload_digest == digest


_hash_of = {}


def word_hash(word):
    """The operators' own hash of a word: rules that take the least hash need it."""
    from nearfold.llm.textbatch import hashes

    if word not in _hash_of:
        raw = np.frombuffer(word.encode(), np.uint8)
        _hash_of[word] = int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    return _hash_of[word]


def unit_spans(text, least):
    """(first word, end word, words) of lines, paragraphs and runs between cuts, found word by word."""
    words = [(m.start(), m.end(), m.group().translate(LOWER)) for m in WORD.finditer(text)]
    n, units_, line_starts, paragraph = len(words), set(), [], []
    at, w = 0, 0
    for line in [*text.split("\n"), None]:
        end = w
        while line is not None and end < n and words[end][1] <= at + len(line):
            end += 1
        if end > w:
            units_.add((w, end))
            line_starts.append(w)
            paragraph.append((w, end))
        elif paragraph:
            units_.add((paragraph[0][0], paragraph[-1][1]))
            paragraph = []
        w, at = end, at + len(line or "") + 1
    if n >= least:
        width = (least + 2) // 3
        stop = [x[2][-1] in ".!?" for x in words]
        cut = list(stop)
        for i in range(n - width + 1):
            if not any(stop[i : i + width]):
                low = min(word_hash(x[2]) for x in words[i : i + width])
                for j in range(i, i + width):
                    cut[j] = cut[j] or word_hash(words[j][2]) == low
        cuts = sorted({0, n, *line_starts, *(i + 1 for i in range(n) if cut[i])})
        for a in cuts:
            b = next((c for c in cuts if c >= a + least), None)
            if b is not None:
                units_.add((a, b))
    return words, units_


def brute_units(texts, least):
    """{doc: [(start, end, first doc, first start, words)]} of the repeated spans."""
    seen, parsed = {}, {}
    for d in sorted(texts):
        parsed[d] = words, spans_ = unit_spans(texts[d] or "", least)
        for a, b in sorted(spans_):
            seen.setdefault(tuple(x[2] for x in words[a:b]), (d, words[a][0]))
    found = {}
    for d, (words, spans_) in parsed.items():
        done = []
        for a, b in sorted(spans_):
            first = seen[tuple(x[2] for x in words[a:b])]
            if first == (d, words[a][0]):
                continue
            if done and a <= done[-1][1]:
                same = a == done[-1][0]
                done[-1] = (done[-1][0], max(b, done[-1][1]), min(first, done[-1][2]) if same else done[-1][2])
            else:
                done.append((a, b, first))
        done = [(words[a][0], words[b - 1][1], *first, b - a) for a, b, first in done if b - a >= least]
        if done:
            found[d] = done
    return found


def test_op9(spark, sf, docs):
    found = collections.defaultdict(list)
    for r in queries.op9_unit_dedup(spark, sf).orderBy("doc_id", "start").collect():
        found[r.doc_id].append((r.start, r.end, r.first_doc_id, r.first_start, r.words))
        assert r.by_lines or r.by_runs
    assert found and found == brute_units(docs, units.MIN_WORDS)


def test_short_lines_and_paragraphs(spark):
    verse = "one two three\nfour five six\nseven eight nine ten\neleven twelve\n\nlast words"
    texts = {1: verse, 2: "a b c\n" + verse.replace("two", "TWO") + "\nx y z", 3: "one two three\nother text here", 4: "p q r\n" + verse.replace("\n", " ")}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for least in (1, 5, 14):
        found = collections.defaultdict(list)
        for r in units.repeats(df, "doc_id", "text", least).orderBy("doc_id", "start").collect():
            found[r.doc_id].append((r.start, r.end, r.first_doc_id, r.first_start, r.words))
        assert found == brute_units(texts, least) and 2 in found
    assert 3 not in found and found[2][0][4] == 14


def lines_and_paragraphs(text):
    """{(start, end): (is a line, is a paragraph, words)} of the lines and paragraphs with a word."""
    found, paragraph, at = {}, [], 0
    for line in [*text.split("\n"), ""]:
        words = [(at + m.start(), at + m.end(), m.group().translate(LOWER)) for m in WORD.finditer(line)]
        if words:
            found[words[0][0], words[-1][1]] = (True, False, tuple(w[2] for w in words))
            paragraph += words
        elif paragraph:
            key = paragraph[0][0], paragraph[-1][1]
            found[key] = (key in found, True, tuple(w[2] for w in paragraph))
            paragraph = []
        at += len(line) + 1
    return found


@pytest.mark.parametrize("min_places", [None, 5])
def test_every_repeated_line_and_paragraph(spark, sf, docs, min_places):
    texts = {d: t or "" for d, t in docs.items()}
    texts |= {10**6 + k: "All rights reserved.\n\nx%d y%d\nz%d" % (k, k, k) for k in range(6)}
    parsed = {d: lines_and_paragraphs(t) for d, t in texts.items()}
    where = collections.defaultdict(list)
    for d, units_ in parsed.items():
        for (a, b), (_, _, words) in units_.items():
            where[words].append((d, a))
    expected = {}
    for d, units_ in parsed.items():
        for (a, b), (line, para, words) in units_.items():
            if len(where[words]) > 1:
                expected[d, a, b] = (line, para, len(words), len(where[words]), *min(where[words]))
    rows = [(d, t, "en", 0) for d, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[0], rows[-1]], SCHEMA)
    got = units.repeated_units(df, "doc_id", "text", units.MIN_WORDS, min_places).collect()
    assert len(got) == len(expected) > 100
    assert {(r.doc_id, r.start, r.end): (r.line, r.paragraph, r.words, r.places, r.first_doc_id, r.first_start) for r in got} == expected
    spans = collections.defaultdict(list)
    for r in units.repeats(df, "doc_id", "text", units.MIN_WORDS, False, min_places).collect():
        assert r.by_lines and not r.by_runs
        spans[r.doc_id].append((r.start, r.end))
    inside = lambda r: any(a <= r.start and r.end <= b for a, b in spans[r.doc_id])
    first = lambda r: (r.doc_id, r.start) == (r.first_doc_id, r.first_start)
    assert all(r.removed == (inside(r) and not first(r)) for r in got)
    reserved = {r.doc_id: r.removed for r in got if r.doc_id >= 10**6 and r.start == 0}
    assert len(reserved) == 6 and sum(reserved.values()) == (0 if min_places is None else len(reserved) - 1 + (len(where["all", "rights", "reserved."]) > 6))
    hot = collections.defaultdict(set)
    for r in got:
        if r.removed:
            hot[r.doc_id].add((r.start, r.end))
    assert all(any(a <= s_ and e <= b for s_, e in hot[d]) for d, found in spans.items() for a, b in found)


def test_repeated_units_of_awkward_rows(spark, awkward, empty):
    assert units.repeated_units(empty, "doc_id", "text").collect() == []
    assert all(r.doc_id is not None and r.places > 1 for r in units.repeated_units(awkward, "doc_id", "text").collect())


def test_passages_inside_lines_are_cut(spark, awkward, empty):
    rng = np.random.default_rng(4)
    draw = lambda n: " ".join("x%d%s" % (i, "." if i % 9 == 0 else "") for i in rng.integers(0, 10**6, n))
    passage = draw(80)
    rows = [(i, draw(60) + " " + (passage + " " if i % 2 else "") + draw(60), "en", 7) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r.text for r in units.without_repeats(df, "doc_id", "text").collect()}
    for i, text, _, _ in rows:
        if i % 2 and i != 1:
            assert len(text.split()) - len(out[i].split()) >= 40
        else:
            assert out[i] == text
    kept = units.without_repeats(awkward, "doc_id", "text")
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)
    assert units.repeats(empty, "doc_id", "text").collect() == []


def brute_templates(texts, classes, least):
    """{doc: numbers of the lines that go}; ``classes`` gives the class of each document."""
    held = collections.defaultdict(set)  # (leaf, line) -> documents
    at = {}
    for d, text in texts.items():
        for i, line in enumerate((text or "").split("\n")):
            words = tuple(None if re.search("[0-9]", w) else w for w in WORD.findall(line))
            if words:
                held[words].add(d)
                at[d, i] = words
    leaf = lambda words: (len(words), words[: templates.LEAD])
    docs_of, support = collections.defaultdict(set), collections.Counter()
    for words, ds in held.items():
        docs_of[leaf(words)] |= ds
        for p, w in enumerate(words):
            support[leaf(words), p, w] += len({classes[d] for d in ds})
    holders, of = collections.defaultdict(set), collections.defaultdict(set)
    for words, ds in held.items():
        if len(docs_of[leaf(words)]) < least:
            continue
        level = least
        while True:
            t = tuple(w if w is None or support[leaf(words), p, w] >= level else "*" for p, w in enumerate(words))
            solid = sum(w not in (None, "*") for w in t)
            if not solid or solid + t.count(None) < templates.SIMILAR * len(t):
                break
            of[words].add(t)
            holders[leaf(words), t] |= {classes[d] for d in ds}
            level *= 2
    gone = {w for w, ts in of.items() if any(len(holders[leaf(w), t]) >= least for t in ts)}
    found = collections.defaultdict(set)
    for (d, i), words in at.items():
        if words in gone:
            found[d].add(i)
    return found


def class_of(spark, texts):
    rows = spark.createDataFrame([(d, i, t) for i, (d, t) in enumerate(texts.items())], "doc_id long, n long, text string").where("text is not null")
    rows = rows.selectExpr("doc_id", "xxhash64(text) as text_hash", "text")
    return {r.doc_id: r["class"] for r in templates._classes(templates._keyed(rows)).collect()}


def test_op10(spark, sf, docs):
    rows = {r.doc_id: r for r in queries.op10_log_template_tree(spark, sf).collect()}
    gone = brute_templates(docs, class_of(spark, docs), templates.MIN_DOCS)
    assert sum(map(len, gone.values())) > 20
    for d, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for i, x in enumerate(lines) if i not in gone[d]]
        assert rows[d].text == "\n".join(kept) and rows[d].n_dropped == len(gone[d]) and rows[d].n_lines == len(lines)


def test_leaves_hold_several_templates(spark):
    rng = np.random.default_rng(21)
    names, texts = [pseudo(rng, 1) for _ in range(400)], {}
    for i in range(120):
        lines = [f"Posted by {names[i % 37]} in {names[100 + i % 3]}", f"Filed under {names[200 + i]}", f"Posted by the {names[300 + i % 50]} team"]
        lines += [pseudo(rng, 9), f"Page {i} of 900", f"{i} {i}", "Seen by " + pseudo(rng, 3)]
        texts[i] = "\n".join(lines)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r.text for r in templates.without_recurring(df, "doc_id", "text").collect()}
    gone = brute_templates(texts, class_of(spark, texts), templates.MIN_DOCS)
    for d, text in texts.items():
        lines = text.split("\n")
        assert out[d] == "\n".join(x for i, x in enumerate(lines) if i not in gone[d])
        assert out[d].split("\n") == [lines[3], lines[5], lines[6]]


def test_templates_generalise_fields(spark, awkward, empty):
    rows = [(i, f"unique start {i * 7919} of text number a{i}b\nReport today by {name} on the state of the river valley today\nat 10:{i} done in {i} ms", "en", 0) for i, name in enumerate(["ann", "bo", "cy", "di", "ed", "flo"])]
    out = templates.without_recurring(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", min_docs=5).collect()
    assert all("Report" not in r.text and "done" not in r.text for r in out)
    kept = templates.without_recurring(awkward, "doc_id", "text")
    assert kept.columns == [*awkward.columns, "n_lines", "n_dropped"] and kept.count() == len(AWKWARD)
    assert kept.where("doc_id = 2").first().text is None
    assert templates.without_recurring(empty, "doc_id", "text").collect() == []


def pseudo(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n))


def test_recall_of_classes(spark):
    """Families of texts with edits of their own: pairs that share three quarters of their word pairs are in one class, whatever is least in their bands."""
    rng = np.random.default_rng(31)
    texts = {}
    for family in range(120):
        base = pseudo(rng, 120).split()
        for _ in range(5):
            words, edits = list(base), int(rng.integers(0, 13))
            for place in rng.integers(0, 120, edits).tolist():
                words[place] = pseudo(rng, 1)
            texts[len(texts)] = " ".join(words)
    of = class_of(spark, texts)
    pairs = {d: set(zip(t.split(), t.split()[1:])) for d, t in texts.items()}
    near = [(a, b) for a in texts for b in range(a + 1, a - a % 5 + 5) if len(pairs[a] & pairs[b]) >= 0.75 * len(pairs[a] | pairs[b])]
    found = sum(of[a] == of[b] for a, b in near)
    assert len(near) > 300 and found >= 0.9 * len(near), (found, len(near))
    assert all(of[a] != of[b] for a in range(0, 600, 5) for b in range(a + 5, 600, 5))


def test_templates_with_any_hash_are_found_in_short_documents(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(40):  # sources: a header, every third a footer too, over one to four lines of their own
        header, footer = pseudo(rng, 6), pseudo(rng, 5)
        for i in range(6):
            own = [pseudo(rng, 6) for _ in range(1 + (s + i) % 4)]
            rows.append((len(rows), "\n".join([header, *own, *([footer] if s % 3 == 0 else [])]), "en", len(own)))
    out = templates.without_recurring(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", min_docs=5).collect()
    assert all(r.text.count("\n") + 1 == r.start and r.n_lines - r.n_dropped == r.start for r in out)


def test_lines_of_near_copies_are_no_templates(spark):
    rng = np.random.default_rng(12)
    lines = [pseudo(rng, 8) for _ in range(12)]
    rows = []
    for i in range(60):  # each copy has one word of its own in some line
        text = list(lines)
        text[i % 12] = text[i % 12].rsplit(" ", 1)[0] + " " + pseudo(rng, 1)
        rows.append((i, "\n".join(text), "en", 0))
    out = templates.without_recurring(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", min_docs=5).collect()
    assert all(r.n_dropped == 0 for r in out)


def test_copies_elsewhere_do_not_keep_a_template(spark):
    rng = np.random.default_rng(13)
    shared, group = pseudo(rng, 6), [pseudo(rng, 8) for _ in range(9)]
    rows = [(i, "\n".join([shared, *(pseudo(rng, 8) for _ in range(3))]), "en", 3) for i in range(8)]
    rows += [(100 + i, "\n".join([shared, *group[:-1], group[-1].rsplit(" ", 1)[0] + " " + pseudo(rng, 1)]), "en", 9) for i in range(60)]
    out = templates.without_recurring(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", min_docs=5).collect()
    assert len(out) == 68 and all(r.n_dropped == 1 and shared not in r.text and r.text.count("\n") + 1 == r.start for r in out)


def test_every_passage_of_51_words_holds_a_unit(spark):
    rng = np.random.default_rng(14)
    rows, sizes = [], {}
    for i in range(120):
        passage = pseudo(rng, 51 + i % 10)
        for k in range(2):
            rows.append((2 * i + k, " ".join([pseudo(rng, 40), passage, pseudo(rng, 40)]), "en", 0))
        sizes[2 * i + 1] = len(passage.split())
    out = {r.doc_id: len(r.text.split()) for r in units.without_repeats(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    for i, _, _, _ in rows:
        cut = 40 + 40 + sizes.get(i, 0) - out[i] if i % 2 else 0
        assert (units.MIN_WORDS <= cut <= sizes[i]) if i % 2 else out[i] >= 131


def recall(n, places, edits):
    """The share of 150 random items of n words that are candidates after ``edits`` edits, or a change of the word at ``places``."""
    rng = np.random.default_rng(n * 31 + edits)
    draw = lambda k: rng.integers(1, 1 << 63, k).astype(np.uint64)
    items = [draw(n) for _ in range(150)]
    parts, starts, at = [], [], 0
    for item in items:
        words = item.tolist()
        for p in places or sorted(rng.choice(n, edits, replace=False).tolist(), reverse=True):
            kind = 0 if places else int(rng.integers(3))
            words[p : p + (kind != 1)] = [] if kind == 2 else [int(draw(1)[0])]
        parts += [draw(80), np.array(words, np.uint64)]
        starts.append(at + 80)
        at += 80 + len(words)
    flat = np.concatenate([*parts, draw(400)])
    tables = decontam.Tables(items, decontam.Search())
    hits = tables.candidates(np.concatenate([flat, np.zeros(64, np.uint64)]), len(flat)).tolist()
    return len({i for s, i in hits if abs(s - starts[i]) <= max(1, edits)}) / 150


@pytest.mark.parametrize("n", [20, 30, 40, 59, 100, 200])
def test_decontamination_recall_at_the_largest_distance(n):
    assert recall(n, [], n // 10) >= 0.95


@pytest.mark.parametrize("n", [20, 59, 200])
@pytest.mark.parametrize("place", [0, -1])
def test_decontamination_recall_with_another_first_or_last_word(n, place):
    assert recall(n, [place % n], 1) >= 0.95

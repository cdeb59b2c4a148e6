"""Fill-in-middle, periodic runs and multiset fingerprints against brute force and on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_contracts import AWKWARD, SCHEMA, WORD

from nearfold.llm import fill_in_middle as fim, multiset_hash, periodic_runs, queries
from nearfold.llm.textbatch import mix

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    return dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A table of documents with nulls, repeated rows, ties, long texts and clashing extra columns."""
    rows = [(*r[:3], r[3]) for r in AWKWARD]
    rows += [(8, "a<P>b\nc", "en", 1), (9, "x\n\n\ny\\1 $2 {3}\n", "en", 1), (10, "<S", "en", 1), (20, "w " * 5000, "en", 2), (30, "ab\n" * 30_000, "en", 2), (11, "a b c d\n" * 9, "en", 0)]
    folder = tmp_path_factory.mktemp("awkward")
    clash = [(*r, 7, "t") for r in rows]
    spark.createDataFrame(clash, SCHEMA + ", n int, form string").write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_op11(spark, sf, docs, table):
    for folder, rows in ((sf, list(docs.items())), (table[0], [(r[0], r[1]) for r in table[1]])):
        found = sorted(repr(tuple(r)) for r in queries.op11_fill_in_middle(spark, folder).collect())
        expected = []
        for d, text in rows:
            text = text or ""
            h = [int(sha(f"7:{'' if d is None else d}")[8 * i : 8 * i + 8], 16) for i in range(4)]
            units = re.findall(r"[^\n]*\n|[^\n]+", text)
            n = len(units)
            a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
                expected.append((d, n, "plain", None, None, sha(text), sha(text)))
            else:
                form = "spm" if h[3] % 100 < 50 else "psm"
                out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
                expected.append((d, n, form, len(p), len(m), sha(out), sha(text)))
        assert found == sorted(map(repr, expected))


def test_fill_in_middle_with_other_units(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7)) + "é" * (i % 3) + " $1\\") for i in range(60)]
    df = spark.createDataFrame(rows, "k long, body string")
    made = fim.transform(df, "k", "body", seed=3, percent=60, spm_percent=30, unit=r"\S+\s*|\s+", markers=("[pre]", "[suf]", "[mid]"))
    out = made.withColumn("c", fim.parts(F.col("form"), F.col("output"), ("[pre]", "[suf]", "[mid]"))).withColumn("back", fim.restored(F.col("output"), F.col("c"))).collect()
    assert {r.k: r.back for r in out} == dict(rows) and {r.form for r in out} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        fim.transform(df, "k", "body", markers=("<a>", "<a>x", "b"))
    with pytest.raises(ValueError):
        fim.transform(df, "k", "body", markers=("ab", "bc", "d"))


def brute_runs(w, length, exponent):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


@pytest.mark.parametrize(("length", "exponent"), [(24, 3), (6, 3), (9, 4), (30, 5)])
def test_runs_against_brute_force(length, exponent):
    rng, runs = random.Random(length), 0
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5, 50, 1000])) for _ in range(rng.randrange(220))]
            for _ in range(rng.randrange(4)):
                s, p = rng.randrange(len(w) + 1), rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 30])
                for i in range(s + p, min(len(w), s + rng.randrange(10, 150))):
                    w[i] = w[i - p]
            texts.append((w[: rng.randrange(1, 50)] * 6)[:260] if rng.random() < 0.2 else w)
        rows = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        words = mix(np.array([(i + 1) * 100_003 + x for i, w in enumerate(texts) for x in w], np.uint64))
        row, start, end, q = periodic_runs.runs_of(words, rows, length, exponent)
        for i, w in enumerate(texts):
            found = sorted((int(a - rows[i]), int(b - rows[i]), int(c)) for r, a, b, c in zip(row, start, end, q) if r == i)
            expected = brute_runs(w, length, exponent)
            runs += len(expected)
            assert found == expected
    assert runs > 100


def test_grammar_derives_its_texts():
    """Every place of a nonterminal holds the same words, and every pair of a repeated text is one."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 9, 70)
    words = mix(np.concatenate([base, rng.integers(0, 9, 200), base, base, np.full(64, 5)]).astype(np.uint64))
    nodes = periodic_runs.grammar(words, np.array([0, len(words)]), 2)
    for i in range(len(nodes.start)):
        s, m, e = nodes.start[i], nodes.middle[i], nodes.end[i]
        places = nodes.places[nodes.of[i] : nodes.of[i + 1]]
        assert s < m < e and places[0] == s and all((words[p : p + e - s] == words[s:e]).all() for p in places)
        assert all(np.diff(places) >= e - s)
    assert (nodes.end - nodes.start).max() == len(words) and np.diff(nodes.of).max() > 5


def test_runs_of_a_million_words_take_linear_memory():
    for words in (np.zeros(1_000_000, np.int64), np.arange(1_000_000) % 7777, np.random.default_rng(1).integers(0, 2, 200_000)):
        row, start, end, q = periodic_runs.runs_of(mix(words.astype(np.uint64) + np.uint64(1)), np.array([0, len(words)]))
        assert len(words) == 200_000 or (start.tolist(), end.tolist(), q.tolist()) == ([0], [len(words)], [max(1, int(words.max()) + (words.max() > 0))])


def digests(words, runs):
    drop = set()
    for s, e, q in runs:
        drop.update(range(s + q, e))
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2])) if runs else None
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    return (len(runs), *shown, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_op12(spark, sf, docs, table):
    for folder, rows in ((sf, list(docs.items())), (table[0], [(r[0], r[1]) for r in table[1] if len(r[1] or "") < 20_000])):
        columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        out = queries.op12_periodic_runs(spark, folder).select(columns)
        if folder != sf:
            assert out.count() == len(table[1]) and out.where("doc_id = 30").first()[1:5] == (1, 0, 30_000, 1)
            out = out.where("doc_id is null or doc_id not in (6, 30)")
        expected = []
        for d, text in rows:
            words = WORD.findall(text or "")
            h = None if d is None else zlib.crc32(str(d).encode())
            if h is not None and h % 10 == 0 and words:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            expected.append((d, *digests(words, brute_runs(words, 24, 3))))
        found = sorted(repr(tuple(r)) for r in out.collect())
        assert found == sorted(map(repr, expected))
        assert folder != sf or sum(r[1] for r in expected) > 10


def test_runs_of_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    out = periodic_runs.find(df, "doc_id", "text").collect()
    assert len(out) == len(AWKWARD) and periodic_runs.find(df.limit(0), "doc_id", "text").collect() == []
    by = {r.doc_id: r for r in out}
    assert by[2].n_words == by[3].n_words == by[4].n_words == 0 and by[2].collapsed == by[4].collapsed == "" and by[2].runs == []
    assert [tuple(x) for x in by[6].runs] == [(0, 30_000, 10)] and by[6].collapsed == "one two three four five six seven eight nine ten"
    assert by[7].collapsed == AWKWARD[-1][1]
    with pytest.raises(ValueError):
        periodic_runs.find(df, "doc_id", "text", min_exponent=2)


def vector_of(text):
    equal, pieces = [0] * 8, re.findall(r"[^\n.!?]{1,128}", text)
    for p in re.findall(r"[^\n]*[^\x20\x09-\x0D][^\n]*", text):
        for k, d in enumerate((sha(p), sha("2" + p))):
            for i in range(4):
                equal[4 * k + i] = (equal[4 * k + i] + int(d[15 * i : 15 * i + 15], 16)) % (1 << 60)
    ds = [hashlib.md5(p.encode()).hexdigest() for p in pieces]
    hs = [[int(d[:15], 16), int(d[15:30], 16)] for d in ds]
    bits = [(k, j + 30 * top) for top in (0, 1) for k in (0, 1) for j in range(30)]
    return equal, len(pieces), [sum(1 if h[k] >> b & 1 else -1 for h in hs) for k, b in bits]


def encoded(v):
    return "".join(f"{x:015x}" for x in v[0]) + f":{v[1]}:" + ",".join(map(str, v[2]))


def like(u, v):
    if u == v:
        return 1.0
    norms = sum(x * x for x in u[2]) + sum(x * x for x in v[2])
    return max(0.0, 2 * sum(x * y for x, y in zip(u[2], v[2])) / norms) if norms else 0.0


def test_op13(spark, sf, docs):
    rows = {r.doc_id: r for r in queries.op13_multiset_fingerprints(spark, sf).collect()}
    ids, better = sorted(docs), 0
    vectors = {d: vector_of(docs[d]) for d in ids}
    for d, after in zip(ids, [*ids[1:], ids[0]]):
        text, n = docs[d], len(docs[d])
        edited = text[: n - n // 2] + docs[after][: n // 2]
        v = vector_of(edited)
        expected = (d, n, sha(edited), encoded(vectors[d]), encoded(v), like(vectors[d], v), like(vectors[d], vectors[after]))
        assert tuple(rows[d])[:5] == expected[:5] and all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(rows[d][5:], expected[5:]))
        better += rows[d].near_edited > rows[d].near_next
    assert better > 0.9 * len(ids)


def test_op13_on_awkward_rows(spark, table):
    folder, rows = table
    out = queries.op13_multiset_fingerprints(spark, folder).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(repr(r.doc_id) for r in out) == sorted(repr(r[0]) for r in rows)
    assert {(r.doc_id, r.fingerprint) for r in out} == {(d, encoded(vector_of(t))) for d, t in order}
    edited = {(r.doc_id, r.edited_sha256) for r in out}
    for (d, t), (_, after) in zip(order, [*order[1:], order[0]]):
        assert (d, sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2])) in edited
    one = spark.createDataFrame([(1, "abc\ndef")], "doc_id long, text string")
    assert [tuple(r)[3] for r in multiset_hash.neighbours(one, "doc_id", "text").collect()] == ["abc\ndef"]
    assert multiset_hash.neighbours(one.limit(0), "doc_id", "text").collect() == []


def test_one_id_may_hold_most_rows(spark):
    """The rows of a hot id are dealt to several ranges, and each row still meets the one after it."""
    rows = [(7, f"text {i}") for i in range(400)] + [(i + (i > 6), f"own {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = multiset_hash.neighbours(df, "doc_id", "text").select("doc_id", "text", "next_text").collect()
    follow = {r.text: r.next_text for r in found}
    assert len(follow) == 420 == len(set(follow.values()))
    text, seen = "own 0", []
    for _ in range(420):
        seen.append(text)
        text = follow[text]
    assert text == "own 0" and [t for t in seen if t.startswith("own")] == [f"own {i}" for i in range(20)] and all(seen[i].startswith("text") for i in range(7, 407))


def test_paragraphs_are_put_in_and_taken_out(spark):
    parts = ["first one. with two", "second", "  third!  ", "second"]
    rows = spark.createDataFrame([("\n".join(parts), "\n\n".join(reversed(parts)), parts[0], "\n".join(parts[1:]), "second\nsecondx")], "a string, b string, c string, d string, e string")
    v = {c: multiset_hash.vector(F.col(c)) for c in "abcde"}
    got = rows.select(
        (v["a"] == v["b"]).alias("order"), (multiset_hash.added(v["c"], v["d"]) == v["a"]).alias("insert"), (multiset_hash.removed(v["a"], v["c"]) == v["d"]).alias("delete"),
        (v["a"] == v["e"]).alias("other"), multiset_hash.likeness(v["a"], v["b"]).alias("same"), multiset_hash.likeness(v["c"], multiset_hash.vector(F.lit(None).cast("string"))).alias("none"),
    ).first()
    assert tuple(got) == (True, True, True, False, 1.0, 0.0)
    assert encoded(vector_of("\n".join(parts))) == rows.select(multiset_hash.encoded(v["a"])).first()[0]

"""The pipeline's stages, each against brute force on its own input."""

import collections
import functools
import re

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
from nearfold.llm import queries, templates
from test_contracts import LONG, LOWER, WORD, brute_components, brute_distance_at_most, brute_kept, brute_templates, class_of, library, pseudo, word_hash  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def word_hashes(text):
    return np.array([word_hash(w) for w in WORD.findall((text or "").translate(LOWER))], np.uint64)


def test_stages_and_run(spark, sf, library):  # noqa: F811
    import __spark_entry__
    import sentencepiece

    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    items = [word_hashes(t).tolist() for t in pq.read_table(f"{sf}/benchmark.parquet").column("text").to_pylist()]
    piece_ids = functools.cache(sentencepiece.SentencePieceProcessor(model_file=str(queries.PIECES)).encode)
    state = {r.doc_id: r for r in docs.collect()}
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, frames[-1], sf)
        assert df.columns == COLUMNS
        frames.append(spark.createDataFrame(df.collect(), df.schema))
    quality, lines, joined, clean = ({r.doc_id: r for r in f.collect()} for f in frames[1:])
    # quality: what the rules keep stays as it is, the rest goes
    assert quality == {d: r for d, r in state.items() if brute_kept(r.text, r.lang, library, piece_ids)}
    assert 0 < len(quality) < len(state)
    # lines: all documents stay without the lines whose template recurs among them
    texts = {d: r.text for d, r in quality.items()}
    gone = brute_templates(texts, class_of(spark, texts), templates.MIN_DOCS)
    assert sum(map(len, gone.values())) > 10 and lines.keys() == quality.keys()
    for d, r in lines.items():
        assert r.text == "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone[d])
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (quality[d].lang, quality[d].source)
    # join: the smallest of each group stays
    groups = brute_components({d: r.text for d, r in lines.items()}, 5, 80, 100)
    assert joined.keys() == {d for d, (_, c) in groups.items() if c == d}
    assert all(lines[d] == r for d, r in joined.items())
    # decontamination: documents with a passage within a tenth of an item's words go, by edit distance; no other goes
    exact, near = set(), set()
    for d, r in joined.items():
        words = word_hashes(r.text)
        held = set(words.tolist())
        for target in items:
            allowed = len(target) // 10
            if sum(w not in held for w in target) <= allowed and (distance := brute_distance_at_most(words, target)) <= allowed:
                near.add(d)
                if distance == 0:
                    exact.add(d)
    left = joined.keys() - clean.keys()
    assert exact <= left <= near and len(left) >= 0.9 * len(near)
    assert all(joined[d] == r for d, r in clean.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, frames[-1], sf).collect()
    assert {r.doc_id for r in packed} == clean.keys()
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_no_import_guard_outside_the_entry():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [root / "corpus_pipeline.py", *(root / "nearfold/llm").glob("*.py")]:
        assert not re.search(r"except \(?(ImportError|ModuleNotFoundError|Exception)", path.read_text())


def test_stages_on_awkward_rows(spark, sf):
    """What each stage makes of nulls, empty, short and very long texts, repeated rows and ids, columns with clashing names and no rows."""
    good = pseudo(np.random.default_rng(5), 300)
    passage = pq.read_table(f"{sf}/benchmark.parquet").column("text")[0].as_py()
    held, shown = f"{pseudo(np.random.default_rng(6), 60)} {passage}", pseudo(np.random.default_rng(7), 60)
    rows = [
        (1, None, None, None, None, "c", 7), (2, "", "en", "s", 0, None, None), (3, "a b", "xx", "s", 3, "c", 1), (3, "a b", "xx", "s", 3, "c", 1),
        (None, LONG, "en", "s", len(LONG), "c", 1), (4, LONG, "en", "s", len(LONG), "c", 1), (5, good, "en", "s", len(good), "c", 1), (6, good, "en", "s", len(good), None, 2),
        (7, held, "en", "s", len(held), "c", 1), (8, shown, None, "s", len(shown), "c", 1), (None, held, "en", "s", len(held), "c", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, n_words int")
    stages = dict(corpus_pipeline.STAGES)
    found = {}
    for name, stage in list(stages.items())[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        found[name] = collections.Counter(map(tuple, out.collect()))
        assert stage(spark, docs.limit(0), sf).collect() == []
    every = collections.Counter(rows)
    only = lambda *ids: collections.Counter(r for r in rows if r[0] is None or r[0] in ids)
    assert found["line dedup"] == every  # no template is in five classes
    assert found["n-gram jaccard join"] == only(1, 2, 3, 4, 5, 7, 8)  # 6 goes; a null id stays and groups with nothing
    assert found["benchmark decontamination"] == only(1, 2, 3, 4, 5, 6, 8)
    kept = found["quality rules"]
    assert kept <= every and all(r[0] not in (1, 2, 3, 4) for r in kept) and sum(r[0] is None for r in kept) == 2
    packed = stages["best-fit packing"](spark, docs, sf).collect()
    pieces = collections.defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append((r.start, r.length))
    assert pieces[1] == pieces[2] == [(0, 1)] and len(pieces[3]) == 2 and len(pieces[4]) > 1
    at = 0
    for start, length in sorted(pieces[4]):
        assert start == at and length <= 1024
        at += length
    assert sorted(pieces[5]) == sorted(pieces[6]) and sum(n for _, n in pieces[None]) == at + sum(n for _, n in pieces[7])
    assert stages["best-fit packing"](spark, docs.limit(0), sf).collect() == []

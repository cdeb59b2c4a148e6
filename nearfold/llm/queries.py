"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfold.llm import (
    decontam,
    fertility,
    fill_in_middle,
    multiset_hash,
    ngram_join,
    packing,
    periodic_runs,
    templates,
    token_files,
    token_rollup,
    units,
    url_lists,
    warc,
)
from nearfold.plans.storage import fresh_dir, written

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
FIRST_DAY = "2024-01-01"
WORDS = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.classes(_table(spark, sf_dir, "documents"), "doc_id", "text", k=3, num=90, den=100)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, each ended by id 0, read back frame by frame."""
    manifest = token_files.write(_table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_BPE, end_id=0)
    return token_files.read(manifest)


def op3_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and tokeniser fertility bands over every whole text."""
    return fertility.verdicts(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang", BYTE_BPE, PIECES).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "entropy", "fallback_share",
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each ended by id 2, packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_BPE, end_id=2)


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents come in; copies of earlier ones go out; the rest is
    revised to counts with an end token, under a second version; the second batch is committed again."""
    docs = _table(spark, sf_dir, "documents")
    rows = written(token_rollup.counts(docs, "doc_id", "text", BYTE_BPE), "counts").withColumn("tokenizer_version", F.lit("byte_bpe_50k/1"))
    first = written(rows.groupBy("text_hash").agg(F.min("doc_id").alias("first")), "first")  # written: a hot text can be split in the join
    flagged = rows.join(first.hint("merge"), "text_hash").withColumn("copy", ~F.col("doc_id").eqNullSafe(F.col("first")))
    copies, rest = flagged.where("copy"), flagged.where("not copy")
    second = rest.withColumn("tokenizer_version", F.lit("byte_bpe_50k/2"))
    rollup = token_rollup.Rollup(spark, fresh_dir(spark, "rollup"))
    rollup.commit("ingest", token_rollup.inserts(rows))
    rollup.commit("copies", token_rollup.deletes(copies))
    rollup.commit("second-version", token_rollup.inserts(second))
    revised = second.withColumnRenamed("n_tokens", "old_tokens").withColumn("n_tokens", F.col("old_tokens") + 1)
    rollup.commit("end-tokens", token_rollup.revisions(revised))
    rollup.commit("copies", token_rollup.deletes(copies))
    return rollup.totals()


def op6_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page evaluated against the list entries active on the day it was fetched (page_id days into 2024, by the year)."""
    pages = _table(spark, sf_dir, "pages")
    fetched = pages.select("page_id", "url", F.expr(f"date_add(date'{FIRST_DAY}', cast(page_id % 366 as int))").alias("day"))
    listed = url_lists.intervals(url_lists.derived_entries(pages, "url"))
    return url_lists.evaluate(fetched, "page_id", "url", "day", listed).select(
        F.col("capture_id").alias("page_id"), "host", F.col("fetch_day").cast("string").alias("fetch_day"),
        "n_block", "n_allow", "lists", "decision",
    )


OP6_SQL = r"""
with captured as (
  select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)', 1)) as host,
         date '2024-01-01' + cast(page_id % 366 as integer) as fetch_day
  from pages
), hosts as (
  select distinct host from captured where host <> ''
), host_keys as (
  select host, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
         lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) as key
  from hosts
), digits as (
  select key, list_transform(range(1, 6), lambda i: cast('0x' || substr(md5(key), i, 1) as integer)) as d
  from (select distinct key from host_keys)
), named as (
  select key, d, case when d[1] <= 5 then 'abuse' when d[1] <= 8 then 'adult' when d[1] = 9 then 'trusted' end as list,
         date '2024-01-01' + cast(16 * d[2] + d[3] as integer) as added
  from digits where d[1] <= 9
), spells as (
  select list, key, added as from_day, added + cast(30 + d[4] as integer) as to_day from named
  union all
  select list, key, added + cast(90 + d[4] as integer), null from named where d[5] <= 7
), hits as (
  select c.page_id, s.list
  from captured c join host_keys k on k.host = c.host join spells s on s.key = k.key
   and c.fetch_day >= s.from_day and (s.to_day is null or c.fetch_day < s.to_day)
), found as (
  select page_id, count(*) filter (where list <> 'trusted') as n_block, count(*) filter (where list = 'trusted') as n_allow,
         string_agg(distinct list, ',' order by list) as lists
  from hits group by page_id
)
select c.page_id, c.host, cast(c.fetch_day as varchar) as fetch_day, coalesce(n_block, 0) as n_block,
       coalesce(n_allow, 0) as n_allow, coalesce(lists, '') as lists,
       case when n_allow > 0 then 'allow' when n_block > 0 then 'block' else 'pass' end as decision
from captured c left join found f on f.page_id = c.page_id
"""


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in documents, within a tenth of their words."""
    return decontam.matches(
        _table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text"
    )


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, found again through the two-level index and read from the archives."""
    pages = _table(spark, sf_dir, "pages")
    index = warc.build_index(warc.write(pages, "page_id", "url", "html"))
    return warc.lookup(index, warc.keys_of(pages, "url")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of repeated lines and runs of 25 words or more, but for their earliest occurrence."""
    return units.repeats(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_log_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    return templates.without_recurring(_table(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", "text", "n_lines", "n_dropped"
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines dealt to prefix, middle and suffix, and read back."""
    made = fill_in_middle.transform(_table(spark, sf_dir, "documents"), "doc_id", "text", seed=7, percent=100, spm_percent=50)
    made = made.withColumn("cut", fill_in_middle.parts(F.col("form"), F.col("output")))
    digest = lambda text: F.sha2(text, 256)
    return made.select(
        "doc_id", "n", "form", F.length("cut.prefix").cast("long").alias("prefix_chars"), F.length("cut.middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored(F.col("output"), F.col("cut"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
with drawn as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as d,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units
  from documents
), numbers as (
  select doc_id, text, units, len(units) as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2,
         ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4
  from drawn
), cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from numbers
), cut as (
  select *, array_to_string(list_slice(units, 1, a), '') as prefix, array_to_string(list_slice(units, a + 1, b), '') as middle,
         array_to_string(list_slice(units, b + 1, n), '') as suffix
  from cuts
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from cut
"""


def _with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic end in one of ten documents, by the checksum of the id; a null id is left alone."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    n, a, p = F.size("words"), F.col("a"), F.col("p")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    periodic = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p)))
    return rows.select("doc_id", F.when(n > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, after one in ten has been given a periodic end, and its words without the repeats."""
    found = periodic_runs.find(_with_periods(_table(spark, sf_dir, "documents")), "doc_id", "text")
    longest = lambda a, b: (  # noqa: E731  by length / period, exactly; runs come by start, then period
        F.when(a["length"] * b["period"] > b["length"] * a["period"], -1)
        .when(a["length"] * b["period"] < b["length"] * a["period"], 1)
        .otherwise(F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])), -1).otherwise(1))
    )
    best = F.get(F.array_sort("runs", longest), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last half replaced from the next document, and their likeness."""
    rows = multiset_hash.neighbours(_table(spark, sf_dir, "documents"), "doc_id", "text")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_vector", multiset_hash.vector(F.col("edited")))
    own, other, following = F.col("vector"), F.col("edited_vector"), F.col("next_vector")
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), multiset_hash.encoded(own).alias("fingerprint"),
        multiset_hash.encoded(other).alias("edited_fingerprint"), multiset_hash.likeness(own, other).alias("near_edited"),
        multiset_hash.likeness(own, following).alias("near_next"),
    )


def _op13_sql() -> str:
    paragraph, piece, eight = r"[^\n]*[^\x20\x09-\x0D][^\n]*", r"[^\n.!?]{1,128}", range(8)
    digit = lambda d, i: f"('0x' || substr({d}, {15 * i + 1}, 15))::bigint"
    lanes = [f"coalesce(sum(cast((h{k} >> {j + 30 * top}) & 1 as bigint)), 0)" for k, top in ((0, 0), (1, 0), (0, 1), (1, 1)) for j in range(30)]
    return f"""with docs as (
  select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id) as k, count(*) over () as total from documents
), follow as (
  select a.k, a.doc_id, a.text, b.text as next_text, b.k as next_k, length(a.text) as n from docs a join docs b on b.k = a.k % a.total + 1
), halves as (
  select k, doc_id, n, next_k, text, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) as edited from follow
), texts as (select k, 0 as e, text from halves union all select k, 1, edited from halves
), paragraphs as (
  select k, e, sha256(p) as d, sha256('2' || p) as d2 from (select k, e, unnest(regexp_extract_all(text, '{paragraph}')) as p from texts)
), equal as (
  select k, e, {", ".join(f"cast(sum({digit('d' if i < 4 else 'd2', i % 4)}::hugeint) % 1152921504606846976 as bigint) as q{i}" for i in eight)}
  from paragraphs group by 1, 2
), hashed as (
  select k, e, {digit("d", 0)} as h0, {digit("d", 1)} as h1 from (select k, e, md5(unnest(regexp_extract_all(text, '{piece}'))) as d from texts)
), counted as (select k, e, count(*) as m, [{", ".join(lanes)}] as lanes from hashed group by 1, 2
), vectors as (
  select t.k, t.e, coalesce(c.m, 0) as m, list_transform(coalesce(c.lanes, [0 for x in range(120)]), lambda x: cast(2 * x - coalesce(c.m, 0) as bigint)) as v,
         {" || ".join(f"lpad(lower(to_hex(coalesce(q{i}, 0))), 15, '0')" for i in eight)} as q
  from texts t left join equal using (k, e) left join counted c using (k, e)
), prints as (select k, e, m, v, q || ':' || m || ':' || array_to_string(v, ',') as f from vectors
), likes as (
  select x.k as a, y.k as b, y.e, case when x.f = y.f then 1.0 else
         case when list_dot_product(x.v::double[], x.v::double[]) + list_dot_product(y.v::double[], y.v::double[]) > 0
              then greatest(0, 2 * list_dot_product(x.v::double[], y.v::double[]) / (list_dot_product(x.v::double[], x.v::double[]) + list_dot_product(y.v::double[], y.v::double[]))) else 0 end end::double as near
  from halves z join prints x on x.k = z.k and x.e = 0 join prints y on (y.k = z.k and y.e = 1) or (y.k = z.next_k and y.e = 0)
)
select z.doc_id, z.n as n_chars, sha256(z.edited) as edited_sha256, p.f as fingerprint, r.f as edited_fingerprint, l.near as near_edited, o.near as near_next
from halves z join prints p on p.k = z.k and p.e = 0 join prints r on r.k = z.k and r.e = 1
join likes l on l.a = z.k and l.b = z.k and l.e = 1 join likes o on o.a = z.k and o.b = z.next_k and o.e = 0"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_token_files,
        op3_fertility_rules,
        op4_best_fit_packing,
        op5_token_rollups,
        op6_temporal_url_lists,
        op7_cgk_decontamination,
        op8_warc_index,
        op9_unit_dedup,
        op10_log_template_tree,
        op11_fill_in_middle,
        op12_periodic_runs,
        op13_multiset_fingerprints,
    )
}

ORACLE_SQL = {"op6_temporal_url_lists": OP6_SQL, "op11_fill_in_middle": OP11_SQL, "op13_multiset_fingerprints": _op13_sql()}

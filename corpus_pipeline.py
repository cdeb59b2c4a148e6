"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

A stage works on all that the stage before it kept, and its decisions take effect: rejected documents,
recurring lines, near copies and contaminated documents are gone from its result. All stages but the
last return the columns of documents. Rows with a null doc_id pass the first three filters and are
packed; rows of one id are kept or dropped together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfold.llm import decontam, fertility, ngram_join, packing, templates
from nearfold.llm.queries import BYTE_BPE, PIECES
from nearfold.plans.storage import delete, fresh_dir, scratch


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules by tokeniser fertility: documents that they reject go."""
    found = fertility.verdicts(docs, "doc_id", "text", "lang", BYTE_BPE, PIECES)
    return _without(docs, found.where("not kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup by template: lines whose template recurs across documents go; n_chars is that of the new text."""
    clean = templates.without_recurring(docs, "doc_id", "text")
    changed = clean.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(docs.columns)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join over five-word shingles at 0.8: of each group the smallest doc_id stays."""
    with scratch(spark) as kept:
        found = ngram_join.classes(docs, "doc_id", "text", k=5, num=80, den=100)
        near = kept(found.where("component_id <> doc_id").select("doc_id"), "near")
    return _without(docs, near)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a passage of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontam.matches(docs, "doc_id", "text", items, "item_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 1024 tokens: one row per piece."""
    return packing.pack_documents(docs, "doc_id", "text", BYTE_BPE, end_id=2)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenisers, similarity and edit distance are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again.

    A stage's table is deleted as soon as the next one is written; that of the last stage but one stays, as the result reads it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        found, path = stage(spark, docs, sf_dir), fresh_dir(spark, name.replace(" ", "-"))
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

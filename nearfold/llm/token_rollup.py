"""Token totals by source, language and tokenizer version, maintained from signed changes.

A batch of changes becomes one small partial of sums, written as one partition named by the
batch id. A batch that has been committed is not written again, so a replay changes nothing; a
task or driver that is lost half-way leaves a partition without its mark of success, which the retry replaces. Totals are the sums over the partials; ``compact``
folds committed partials into one and remembers their ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfold.llm.chunkcoder import coder
from nearfold.llm.files import place
from nearfold.llm.textbatch import utf8
from nearfold.plans.storage import written

KEYS = ["source", "lang", "tokenizer_version"]
PARTIAL = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, folded array<string>, batch_id string"


def counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(doc_id, n_tokens, text_hash, and the columns to keep as strings): the number of token ids of every whole text.

    A null text has 0. Every row gives one row, whatever its id: nulls and repeated ids stay as they are.
    """

    def run(batches):
        for batch in batches:
            n = np.array([len(x) for x in coder(vocabulary).encode(*utf8(batch.column(2)))], np.int64)
            yield pa.record_batch([batch.column(0), pa.array(n), batch.column(1), *batch.columns[3:]], ["doc_id", "n_tokens", "text_hash", *keep])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_hash"), text.alias("text"), *(F.col(c).cast("string").alias(c) for c in keep)
    )
    return rows.mapInArrow(run, "doc_id long, n_tokens long, text_hash string" + "".join(f", `{c}` string" for c in keep))


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add documents; ``rows`` has KEYS and n_tokens."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long"))


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take documents back; ``rows`` has KEYS and the n_tokens that were counted for them."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revisions(rows: DataFrame) -> DataFrame:
    """Changes of counts; ``rows`` has KEYS, old_tokens and n_tokens."""
    return rows.select(
        *KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("n_tokens") - F.col("old_tokens")).cast("long").alias("n_tokens")
    )


class Rollup:
    """The partials in one folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, batch_id: str) -> str:
        return f"{self.folder}/batch_id={batch_id}"

    def _partials(self) -> DataFrame:
        empty = self.spark.createDataFrame([], PARTIAL)
        system, path = place(self.folder)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return empty
        return self.spark.read.schema(PARTIAL).parquet(self.folder)

    def _live(self) -> DataFrame:
        """Partials but those that a compacted one has folded in."""
        every = self._partials()
        folded = every.select(F.explode("folded").alias("batch_id")).distinct()
        return every.join(folded, "batch_id", "left_anti")

    def _committed(self, batch_id: str) -> bool:
        """Whether the job that wrote the batch has ended: an unfinished one leaves no mark and is written anew."""
        system, path = place(self._path(batch_id))
        return system.get_file_info(f"{path}/_SUCCESS").type != fs.FileType.NotFound

    def _put(self, batch_id: str, sums: DataFrame) -> None:
        sums.repartition(1).write.mode("overwrite").parquet(self._path(batch_id))  # summed before: a row per key

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of signed changes once; False if it has been committed, by itself or within a compacted partial.

        Null keys are totals of their own; null counts add nothing; a batch without rows is remembered with no totals.
        """
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        if self._committed(batch_id) or self._partials().where(F.array_contains("folded", batch_id)).take(1):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
        self._put(batch_id, sums.withColumn("folded", F.array().cast("array<string>")))
        return True

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens; keys whose documents are all gone are left out."""
        sums = self._live().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, batch_id: str) -> None:
        """Folds all committed partials into one under a new id; nothing is done if that has been committed.

        The ids folded in are rows of the new partial, with no keys and no counts, so no list of them passes through the driver.
        """
        if self._committed(batch_id):
            return
        every = self._partials().where(F.col("batch_id") != batch_id)
        sums = self._live().where(F.col("batch_id") != batch_id).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums = sums.withColumn("folded", F.array().cast("array<string>"))
        names = every.select("batch_id").unionByName(every.select(F.explode("folded").alias("batch_id"))).distinct()
        none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
        names = names.select(*(none.alias(k) for k in KEYS), zero.alias("n_docs"), zero.alias("n_tokens"), F.array("batch_id").alias("folded"))
        self._put(batch_id, written(sums.unionByName(names), "compacted"))

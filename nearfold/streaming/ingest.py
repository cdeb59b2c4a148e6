"""Incremental ingest: a file stream into a table, exactly once, in bounded batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

FILES_PER_BATCH = 500


def ingest(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, process: Callable[[DataFrame], DataFrame],
    format: str = "parquet", files_per_batch: int = FILES_PER_BATCH, glob: str = "*",
) -> StreamingQuery:
    """Reads what is new under ``source`` and stops. A stopped run goes on where the checkpoint says.

    Each batch is one partition of ``target`` named by its id, so a batch that runs again replaces itself.
    """
    stream = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = stream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(source)

    def put(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the latest batch for each key."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*")


class Progress(StreamingQueryListener):
    """Rows seen and rows a second of the latest batch."""

    def __init__(self):
        self.rows, self.rate, self.batches = 0, 0.0, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if event.progress.numInputRows:
            self.rows += event.progress.numInputRows
            self.rate = event.progress.processedRowsPerSecond
            self.batches += 1

    def onQueryTerminated(self, event):
        pass


def scan_metrics(processed: DataFrame, groups: DataFrame, total: int, elapsed_s: float) -> DataFrame:
    """One row: files_processed, files_total_estimate, files_per_second, percent and groups_found."""
    n = processed.agg(F.count("*").alias("files_processed"))
    g = groups.agg(F.count("*").alias("groups_found"))
    percent = F.least(F.lit(100.0), 100.0 * F.col("files_processed") / F.lit(total)) if total else F.lit(0.0)
    return n.crossJoin(g).select(  # one row each
        "files_processed", F.lit(total).alias("files_total_estimate"),
        (F.col("files_processed") / F.lit(max(elapsed_s, 0.001))).alias("files_per_second"), percent.alias("percent"), "groups_found",
    )

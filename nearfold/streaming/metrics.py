"""Progress of scans as a table: counted while the data is written, by the write's own job, and readable after a restart."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = (
    "session_id string, phase string, files_processed long, files_total_estimate long, files_per_second double, percent double, last_path string, "
    "updated_at timestamp, seq long"
)


class Metrics:
    """The table of metrics under ``path``: a row for each report, appended; the latest of a session is its progress."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def report(self, session_id: str, phase: str, processed: int, total: int, elapsed_s: float, last_path: str | None = None) -> None:
        """Appends one row. Percent is at most 100, and 0 without a total."""
        now = time.time_ns()
        percent = min(100.0, 100.0 * processed / total) if total else 0.0
        row = (session_id, phase, processed, total, processed / max(elapsed_s, 0.001), percent, last_path, dt.datetime.fromtimestamp(now / 1e9), now)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def progress(self) -> DataFrame:
        """The latest row of each session."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        newest = rows.groupBy("session_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "session_id")), "seq").alias("r"))
        return newest.select("session_id", "r.*").drop("seq")

    def write(self, df: DataFrame, path: str, session_id: str, phase: str = "hashing", total: int = 0, mode: str = "overwrite") -> None:
        """Writes ``df`` (with a column path) as Parquet and reports what that job itself has counted: no other job reads the data."""
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("processed"), F.max("path").alias("last_path"))
        began = time.perf_counter()
        counted.write.mode(mode).parquet(path)
        found = seen.get
        self.report(session_id, phase, found["processed"], total, time.perf_counter() - began, found["last_path"])


class StreamReports(StreamingQueryListener):
    """Reports the batches of the streams of one session. Its counts go on from those that the table holds, so a restart does not lose them."""

    def __init__(self, metrics: Metrics, session_id: str, total: int = 0):
        self.metrics, self.session_id, self.total = metrics, session_id, total
        try:
            held = metrics.progress().where(F.col("session_id") == session_id).first()
        except Exception as e:  # no report yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = None
        self.rows = held.files_processed if held else 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if event.progress.numInputRows:
            self.rows += event.progress.numInputRows
            rate = event.progress.processedRowsPerSecond
            self.metrics.report(self.session_id, "hashing", self.rows, self.total, self.rows / rate if rate else 0.0)

    def onQueryTerminated(self, event):
        pass

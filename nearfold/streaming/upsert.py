"""A snapshot of files and fingerprints that a stream of listings keeps up to date, batch by batch and exactly once.

A batch is a folder of changes, ``seq=N`` under ``changes``, with rows of files and their fingerprints together, so that both are there or
neither. N follows from the generation of the scan and the number of the batch; a batch that runs again after a lost driver compares itself with the same
state, that before N, and replaces its own folder. A folder counts once its job has committed (_SUCCESS), so readers see whole
batches at any time. ``compact`` folds the folders into one base of latest rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfold.plans.schemas import EXIF
from nearfold.plans.storage import delete, written
from nearfold.sources.snapshot import new_file_id
from nearfold.streaming.ingest import FILES_PER_BATCH

UPSERT, SEEN, GONE = "upsert", "seen", "gone"
STORED = (
    "size long, mtime_ns long, width int, height int, inode long, created_at timestamp, modified_at timestamp, companion_raw_path string, companion_raw_size long, "
    f"content_hash string, dhash long, phash long, exif {EXIF}"
)
CHANGES = f"op string, session_id string, path string, file_id long, scan_generation long, deleted_at timestamp, {STORED}"
PRINTS = ("content_hash", "dhash", "phash", "exif")
_GENERATION = 1 << 32
_CLOSING = 1 << 31


class SnapshotStream:
    """The snapshot under ``path``; any number of readers, one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self, kind: str) -> dict[int, str]:
        """The folders of ``kind`` whose job has committed, by number: a folder for each batch since the last compaction."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = {}
        for status in system.listStatus(where) if system.exists(where) else []:
            name, _, value = status.getPath().getName().partition("=")
            if name == "seq" and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[int(value)] = status.getPath().toString()
        return found

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self, before: int | None = None, only: list[str] | None = None) -> DataFrame:
        """The latest row of each (session_id, path), live or with deleted_at, and the last generation that saw it; of batches ``before`` a number if given.

        ``only`` names the stored columns that are wanted, so that no other is read and shuffled.
        """
        bases = {n: p for n, p in self._committed("base").items() if before is None or n < before}
        upto = max(bases, default=-1)
        later = {n: p for n, p in self._committed("changes").items() if n > upto and (before is None or n < before)}
        rows = self._read([p for _, p in sorted(later.items())], f"seq long, {CHANGES}")
        base = self._read([bases[upto]] if bases else [], f"seq long, {CHANGES}")
        columns = only or [c for c in rows.columns if c not in ("op", "seq", "session_id", "path", "scan_generation")]
        newest = rows.unionByName(base).groupBy("session_id", "path").agg(
            F.max_by(F.struct(*columns), F.when(F.col("op") != SEEN, F.col("seq"))).alias("r"),
            F.max(F.when(F.col("op") != GONE, F.col("scan_generation"))).alias("scan_generation"), F.max("seq").alias("seq"),
        )
        return newest.select("seq", "session_id", "path", "scan_generation", "r.*")

    def files(self) -> DataFrame:
        """The table of files."""
        return self.state().drop("seq", *PRINTS)

    def fingerprints(self) -> DataFrame:
        """The table of fingerprints."""
        return self.state().select("file_id", *PRINTS)

    def _write(self, rows: DataFrame, seq: int) -> None:
        kinds = self.spark.createDataFrame([], f"seq long, {CHANGES}").schema
        have = set(rows.columns)
        full = rows.select(*((F.col(f.name) if f.name in have else F.lit(seq) if f.name == "seq" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))
        full.write.mode("overwrite").parquet(f"{self.path}/changes/seq={seq}")

    def put(self, listing: DataFrame, generation: int, batch_id: int, fingerprint: Callable[[DataFrame], DataFrame]) -> None:
        """One batch of a listing (session_id, path, size, mtime_ns and any stored columns; a path once).

        ``fingerprint`` gets the new and changed rows with their file_id and returns file_id and fingerprints, width and height too if it knows
        them; rows that it leaves out are not stored and come again as new or changed. Unchanged rows are only marked as seen.
        """
        seq = generation * _GENERATION + batch_id
        if seq <= max(self._committed("base"), default=-1):
            return  # already in the base
        old = self.state(seq, ["file_id", "size", "mtime_ns", "deleted_at"]).where("deleted_at is null").select("session_id", "path", F.col("file_id").alias("_id"), F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"))
        joined = listing.join(old, ["session_id", "path"], "left")
        same = F.col("_id").isNotNull() & F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_mtime"))
        joined = joined.withColumns({"same": same, "file_id": F.coalesce("_id", new_file_id())}).drop("_id", "_size", "_mtime")
        joined = written(joined, "listed")
        todo = joined.where("not same").drop("same")
        prints = written(fingerprint(todo), "prints")
        done = todo.drop(*(c for c in prints.columns if c != "file_id")).join(prints, "file_id").withColumn("op", F.lit(UPSERT))
        seen = joined.where("same").select("session_id", "path", F.lit(SEEN).alias("op"))
        self._write(done.unionByName(seen, allowMissingColumns=True).withColumn("scan_generation", F.lit(generation)), seq)

    def close(self, generation: int, now) -> None:
        """The end of a scan: live files that no batch of ``generation`` has seen or stored get ``now`` as deleted_at. To do it again changes nothing."""
        seq = generation * _GENERATION + _CLOSING
        if seq <= max(self._committed("base"), default=-1):
            return
        lost = self.state(before=seq).where("deleted_at is null").where(F.col("scan_generation") < generation)
        self._write(lost.drop("seq").withColumns({"op": F.lit(GONE), "deleted_at": F.lit(now)}), seq)

    def compact(self) -> None:
        """Folds all committed changes into one base; a reader or a lost driver in between finds the old folders or the new base, never half of it."""
        changes, bases = self._committed("changes"), self._committed("base")
        upto = max(changes, default=-1)
        if upto <= max(bases, default=-1):
            return
        self.state(before=upto + 1).withColumn("op", F.lit(UPSERT)).write.mode("overwrite").parquet(f"{self.path}/base/seq={upto}")
        for n, path in [*changes.items(), *bases.items()]:
            if n <= upto and path != f"{self.path}/base/seq={upto}":
                delete(self.spark, path)

    def ingest(
        self, source: str, schema: str, checkpoint: str, generation: int, listed: Callable[[DataFrame], DataFrame], fingerprint: Callable[[DataFrame], DataFrame],
        format: str = "parquet", glob: str = "*", files_per_batch: int = FILES_PER_BATCH,
    ) -> StreamingQuery:
        """Reads what is new under ``source`` in bounded batches, ``put``s each and stops; ``listed`` makes listing rows of a batch. A stopped run goes on."""
        stream = self.spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
        stream = stream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(source)
        put = lambda batch, batch_id: self.put(listed(batch), generation, batch_id, fingerprint)
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

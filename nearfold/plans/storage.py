"""Written tables in the folder that every executor can reach.

Iterative plans cut their lineage here: a table written to shared storage
survives lost executors, which cached blocks do not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset: a temporary one on a local master, else an error."""
    where = spark.conf.get(SETTING, None)
    if not where:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-nearfold-")
        spark.conf.set(SETTING, where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, or in that of the innermost ``scratch``, that nothing else uses."""
    return f"{_scope.get() or shared_dir(spark) + '/nearfold'}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; the plan starts anew from there."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of shared storage, whatever its scheme; one that is not there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted at the end, but for those written by the function that it gives."""
    outer = _scope.get()
    folder = fresh_dir(spark, "scratch")
    token = _scope.set(folder)

    def kept(df: DataFrame, label: str) -> DataFrame:
        now = _scope.set(outer)
        try:
            return written(df, label)
        finally:
            _scope.reset(now)

    try:
        yield kept
    finally:
        _scope.reset(token)
        delete(spark, folder)

"""Cutting lineage, and tables of batches, in the shared folder that the cluster names."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder is set only where the session names none and is local (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir() and not sc.getConf().get("spark.checkpoint.dir") and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="thoughtloom-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, *more: DataFrame) -> DataFrame:
    """df and more, written to the shared folder and read back, so that a loop's plan stays as small as one of its rounds.

    A checkpoint would keep the constraints of all rounds in the plan, which the optimiser then multiplies.
    """
    path = scratch(df.sparkSession, "settled")
    if getattr(_LEAN, "paths", None) is not None:
        _LEAN.paths.append(path)
    df.write.parquet(path)
    for x in more:
        x.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_LEAN = threading.local()
#: Shuffle files go when a table is written, not when the driver happens to collect its garbage; tables are packed denser.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


@contextlib.contextmanager
def lean(*sessions: SparkSession) -> Iterator[None]:
    """Little disk while tables are written inside: see LEAN; what is settled inside is removed at the end, so nothing that reads it may leave."""
    before = [(s, k, s.conf.get(k, None)) for s in sessions for k in LEAN]
    outer, _LEAN.paths = getattr(_LEAN, "paths", None), []
    try:
        for s, k, _ in before:
            s.conf.set(k, LEAN[k])
        yield
    finally:
        paths, _LEAN.paths = _LEAN.paths, outer
        for s, k, v in reversed(before):
            s.conf.unset(k) if v is None else s.conf.set(k, v)
        for path in paths:
            where = sessions[0]._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sessions[0]._jsc.hadoopConfiguration()).delete(where, True)


#: Rows that a task of a join takes where tasks are dealt by number of rows.
TASK_ROWS = 1_000_000


def tasks_for(df: DataFrame) -> int:
    """Tasks for the rows of a settled table: narrow rows compress so well that tasks of equal bytes hold very many."""
    return max(1, -(-df.count() // TASK_ROWS))


def tasks_over(df: DataFrame) -> int:
    """The same for small tables as well: one task a core at least."""
    return max(tasks_for(df), df.sparkSession.sparkContext.defaultParallelism)


#: Bytes of rows, before their compression, that one part of a job shuffles where it is cut into parts.
PART_BYTES = 1 << 30


def parts_for(size: int | None) -> int:
    """Parts of a job that shuffles so many bytes: they run one after the other, so disk holds those of one."""
    return max(1, -(-(size or 0) // PART_BYTES))


class BatchTable:
    """A table of numbered batches, one folder each: writing a number again replaces it, so a replay changes nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def write_parts(self, parts: Iterable[DataFrame], number: int) -> None:
        """The same for rows that are made part by part."""
        for i, rows in enumerate(parts):
            rows.write.mode("append" if i else "overwrite").parquet(f"{self.path}/batch={number}")

    def read(self, before: int | None = None) -> DataFrame:
        """All batches, or those with a lesser number."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], f"{self.schema}, batch int")
        found = self.spark.read.schema(f"{self.schema}, batch int").option("basePath", self.path).parquet(f"{self.path}/batch=*")
        return found if before is None else found.where(F.col("batch") < before)

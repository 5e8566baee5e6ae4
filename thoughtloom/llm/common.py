"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; a temporary one only where the session has none and is local (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="thoughtloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing will read again: all that was made of them is stored itself."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keyed(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """docs with a column `doc` that is unique: the id, or a row number where ids repeat or are null."""
    odd = docs.groupBy(by).count().where(f"count > 1 OR {by} IS NULL")
    if odd.limit(1).count():
        return stored(docs.withColumn("doc", F.monotonically_increasing_id()), "rows")
    return docs.withColumn("doc", F.col(by))


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, setup: Callable | None = None) -> DataFrame:
    """Columns in, columns out, one Arrow batch at a time (as Python lists). setup() runs once a task."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for b in batches:
            for part in slices(b):
                columns = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                out = fn(columns, state) if setup else fn(columns)
                yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows in this session: a row may be a long text, and batches lie in memory beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def slices(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes, one row at least, so that long texts do not pile up as Python objects."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, type=kind)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space: bytes.split() cuts at exactly space and \\t to \\r."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a fixed bijection)."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x9E3779B97F4A7C15)
    h = h ^ (h >> U64(29))
    h = h * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bounded number of words (a cache: results do not depend on it)."""

    def __init__(self, most: int = 250_000):
        import xxhash

        super().__init__()
        self.most, self.h = most, xxhash.xxh3_64_intdigest

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[w] = x = self.h(w)
        return x

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b).

    Each round gives every node the least label of its neighbours, then follows labels once (so that
    chains shrink by halves); rounds are written to the shared folder. Only nodes with edges take part
    in the rounds. Hot nodes are safe: minima combine before the shuffle.
    """
    both = stored(edges.select("a", "b").where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c"))
    kept = label = stored(label, "labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        step = label.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        hook = step.where("c < old").groupBy(F.col("old").alias("id")).agg(F.min("c").alias("h"))
        step = step.join(hook, "id", "left").select("id", "old", F.least("c", F.coalesce("h", "c")).alias("c"))
        step = stored(step, "step")
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = stored(step.join(jump, "c", "left").select("id", "old", F.coalesce("cc", "c").alias("c")), "labels")
        forget(kept, step)
        changed = new.where("old <> c").limit(1).count()
        kept, label = new, new.select("id", "c")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    forget(both)
    return nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("c", "id").alias("component"))

"""A queue of session messages on a stream: flushed by size, by quiet time, or when asked; failed flushes come back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "session bigint, id bigint, role string, content string"
FLUSHED = "session bigint, batch bigint, id bigint, role string, content string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def queued(messages: DataFrame, flush_requests: DataFrame | None = None, returned: DataFrame | None = None) -> DataFrame:
    """One stream of what a queue hears: messages (session, id, role, content), sessions to flush now, and messages that a sink gave back."""
    columns = ["session", "id", "role", "content"]
    out = messages.select(F.lit("message").alias("kind"), *columns)
    if returned is not None:
        out = out.unionByName(returned.select(F.lit("message").alias("kind"), *columns))
    if flush_requests is not None:
        out = out.unionByName(flush_requests.select(F.lit("flush").alias("kind"), "session"), allowMissingColumns=True)
    return out


class _Queue(StatefulProcessor):
    """Per session the pending messages and the next batch number; a timer that every message sets anew."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "id bigint, role string, content string")
        self.next = handle.getValueState("next", "batch bigint")

    def _emit(self, session, rows: list[tuple]) -> list[tuple]:
        batch = self.next.get()[0] if self.next.exists() else 0
        self.next.update((batch + 1,))
        return [(session, batch, *r) for r in rows]

    def _frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(out, columns=["session", "batch", "id", "role", "content"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = {r[0]: tuple(r) for r in self.pending.get()} if self.pending.exists() else {}
        flush, out = False, []
        for frame in rows:
            for kind, id_, role, content in zip(frame["kind"], frame["id"], frame["role"], frame["content"]):
                if kind == "flush":
                    flush = True
                else:
                    waiting.setdefault(int(id_), (int(id_), role, content))
        # a message that came back is older than those that wait, and goes before them
        order = [waiting[i] for i in sorted(waiting)]
        while len(order) >= self.size or (flush and order):
            out += self._emit(key[0], order[: self.size])
            order = order[self.size :]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if order:
            self.pending.put(order)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        else:
            self.pending.clear()
        yield from self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        self.pending.clear()
        yield from self._frames(self._emit(key[0], rows) if rows else [])

    def close(self) -> None:
        pass


def flushes(heard: DataFrame, size: int = 10, wait_ms: int = 2000) -> DataFrame:
    """(session, batch, id, role, content): the messages of each flush of queued(), in the order of ids.

    A session is flushed at `size` messages, `wait_ms` after its last message, and on request; at most `size` messages
    leave under one number, and numbers of a session only grow. A message that already waits is not taken twice.
    """
    heard.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return heard.groupBy("session").transformWithStateInPandas(_Queue(size, wait_ms), FLUSHED, "Append", "ProcessingTime")


class Deliveries:
    """A foreachBatch function that hands flushed messages to `write`; what it refuses goes back to the queue.

    write(rows, epoch) returns nothing, or a DataFrame (session, batch) of flushes that it could not store; where it
    raises, all of them return. Returned messages are written below `path`, under the number of the batch, before it is
    committed, and the queue's own stream reads them from there with returned(): a restart writes them again in place.
    """

    def __init__(self, spark: SparkSession, path: str, write: Callable[[DataFrame, int], DataFrame | None]):
        self.spark, self.path, self.write = spark, path, write
        spark.createDataFrame([], MESSAGE).write.mode("append").parquet(path)

    def returned(self) -> DataFrame:
        return self.spark.readStream.schema(MESSAGE).parquet(f"{self.path}/*")

    def save(self, rows: DataFrame, epoch: int) -> None:
        kept = rows.persist()
        try:
            if kept.isEmpty():
                return
            try:
                refused = self.write(kept, epoch)
            except Exception:  # noqa: BLE001  (any failure of a sink is one of its flushes)
                refused = kept.select("session", "batch").distinct()
            if refused is not None:
                back = kept.join(refused.select("session", "batch").distinct(), ["session", "batch"], "left_semi")
                back.select("session", "id", "role", "content").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        finally:
            kept.unpersist()

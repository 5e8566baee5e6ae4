"""Streams of transcripts and events. Message time has a watermark of one hour unless given; later rows are dropped."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tables import settled
from .queue import STATE_STORE

LATE = "1 hour"


def stream_lines(spark: SparkSession, path: str, max_files: int = 100, glob: str = "*.jsonl") -> DataFrame:
    """(file_path, modified, value) of new transcript files; the trigger's interval is the quiet time."""
    raw = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(path)
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), "value").where(~F.contains("file_path", F.lit("subagents")) & (F.length(F.trim("value")) > 0))


def gap_sessions(messages: DataFrame, key: str, time: str = "ts", gap: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of messages without a gap; works on streams and tables."""
    m = messages.withWatermark(time, LATE) if messages.isStreaming else messages
    return m.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _windowed(events: DataFrame, time: str, size: str, slide: str | None, **aggs: Column) -> DataFrame:
    e = events.withWatermark(time, LATE) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return e.groupBy(w.alias("w")).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


def error_rate(events: DataFrame, failed: Column, time: str = "ts", threshold: float = 0.05, size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """(start, end, n, rate, breach) of sliding windows."""
    return _windowed(events, time, size, slide, n=F.count(F.lit(1)), rate=F.count_if(failed) / F.count(F.lit(1))).withColumn("breach", F.col("rate") > threshold)


def held(windows: DataFrame, minutes: int = 5) -> DataFrame:
    """Windows (start each minute, breach) whose breach held for all of the last `minutes` starts, by self join on the minute."""
    bad = windows.where("breach").select(F.unix_seconds(F.col("start").cast("timestamp")).alias("s"))
    need = windows.where("breach").select("start", "end", F.unix_seconds(F.col("start").cast("timestamp")).alias("t")).withColumn("s", F.explode(F.sequence(F.col("t") - 60 * (minutes - 1), F.col("t"), F.lit(60))))
    return need.join(bad, "s").groupBy("start", "end").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == minutes).select("start", "end")


class _Run(StatefulProcessor):
    """Per key the start of the last window and how many windows in a row, each a step after the one before, were in breach."""

    def __init__(self, windows: int, step: int):
        self.windows, self.step = windows, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "last bigint, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for start, end, breach in sorted({r for f in rows for r in zip(f["start"], f["end"], f["breach"])}):
            at = int(start.timestamp())
            n = (n + 1 if last == at - self.step else 1) if breach else 0
            last = at
            if n >= self.windows:
                out.append((key[0], start, end))
        self.state.update((last, n))
        yield pd.DataFrame(out, columns=["key", "start", "end"])

    def close(self) -> None:
        pass


def held_stream(windows: DataFrame, key: Column | None = None, minutes: int = 5, step: int = 60) -> DataFrame:
    """(key, start, end) of held() on a stream of closed windows (start, end, breach): state is one run a key.

    A window's watermark closes it before a later one, so windows of a key arrive in order from batch to batch.
    """
    windows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keyed = windows.select((F.lit("") if key is None else key).cast("string").alias("key"), "start", "end", F.coalesce("breach", F.lit(False)).alias("breach"))
    return keyed.groupBy("key").transformWithStateInPandas(_Run(minutes, step), "key string, start timestamp, end timestamp", "Append", "None")


def _quantiles(rows: DataFrame, p: float) -> DataFrame:
    """(start, end, quantile) of rows (start, end, value): exactly the least value that a share p of a window's values does not exceed.

    A sketch brackets the quantile closely; the values outside the bracket are only counted, so a window is never sorted
    whole. Windows whose bracket missed, which a sketch of this accuracy does not expect, are counted value by value.
    """
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(Decimal(str(p)))).cast("bigint"))
    near = F.percentile_approx("value", [max(p - 0.0005, 0.0), min(p + 0.0005, 1.0)], 10_000)
    windows = settled(rows.groupBy("start", "end").agg(near.alias("near"), F.count("value").alias("n")))
    place = Window.partitionBy("start").orderBy("side", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def reached(counts: DataFrame) -> DataFrame:
        up_to = counts.withColumn("up_to", F.sum("times").over(place)).where(F.col("up_to") >= F.col("rank"))
        return up_to.groupBy("start").agg(F.min(F.struct("side", "value")).alias("x")).select("start", "x.side", "x.value")

    met = rows.where("value IS NOT NULL").join(windows.select("start", "near", rank.alias("rank")), "start")
    side = F.when(F.col("value") < F.col("near")[0], -1).when(F.col("value") > F.col("near")[1], 1).otherwise(0)
    counts = met.select("start", "rank", side.alias("side"), "value").groupBy("start", "rank", "side", F.when(F.col("side") == 0, F.col("value")).alias("value"))
    first = settled(reached(counts.agg(F.count(F.lit(1)).alias("times"))))
    missed = met.join(first.where("side <> 0").select("start"), "start", "left_semi").groupBy("start", "rank", F.lit(0).alias("side"), "value").agg(F.count(F.lit(1)).alias("times"))
    found = first.where("side = 0").unionByName(reached(missed)).select("start", F.col("value").alias("quantile"))
    return windows.select("start", "end").join(found, "start", "left").select("start", "end", "quantile")


def latency_alert(events: DataFrame, value: str, time: str = "ts", p: float = 0.95, bound: float = 1.0, size: str = "5 minutes") -> DataFrame:
    """(start, end, quantile, breach): exact on tables; a stream keeps a sketch of each open window, within 1 / 10,000 of its rows."""
    if events.isStreaming:
        found = _windowed(events, time, size, None, quantile=F.percentile_approx(value, p, 10_000))
    else:
        found = _quantiles(events.select(F.window(time, size).alias("w"), F.col(value).alias("value")).select("w.start", "w.end", "value"), p)
    return found.withColumn("breach", F.col("quantile") > bound)


def ratio_alert(events: DataFrame, hit: Column, time: str = "ts", bound: float = 0.3, size: str = "15 minutes") -> DataFrame:
    return _windowed(events, time, size, None, n=F.count(F.lit(1)), ratio=F.count_if(hit) / F.count(F.lit(1))).withColumn("breach", F.col("ratio") < bound)


def absence_alert(events: DataFrame, wanted: Column, related: Column, time: str = "ts", least: int = 10, size: str = "1 hour") -> DataFrame:
    """Windows with more than `least` related events and none that is wanted."""
    return _windowed(events, time, size, None, wanted=F.count_if(wanted), related=F.count_if(related)).withColumn("breach", (F.col("wanted") == 0) & (F.col("related") > least))


def notify_once(notifications: DataFrame, time: str = "created_at") -> DataFrame:
    """Each (type, user, subject) of a stream once within the watermark."""
    return notifications.withWatermark(time, LATE).dropDuplicatesWithinWatermark(["type", "user_id", "subject"])

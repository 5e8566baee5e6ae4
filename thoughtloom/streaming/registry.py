"""Each file's content once, over all time: a ledger of hashes that a batch of files extends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import BatchTable, settled
from ..sources.transcripts import content_hashes, numbered_lines, parse_messages, parsed_lines, split_conversations

Write = Callable[[DataFrame, int], None]


class FileLedger:
    """Content hashes (hash, path, conversations) of files that gave a conversation, by number of the batch.

    process() takes the numbered lines of a batch of files, leaves out files whose content an earlier batch has in the
    ledger (one path of equal ones stays), hands the messages of the others to `write`, and records those files last. A
    file without a conversation is not recorded, so it is read again when it comes again. A batch that is run again
    meets only lesser numbers and replaces its own rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, BatchTable(spark, path, "hash string, path string, conversations bigint")

    def process(self, lines: DataFrame, number: int, write: Write) -> None:
        files = content_hashes(lines).groupBy("hash").agg(F.min("file_path").alias("file_path"))
        new = settled(files.join(self.table.read(number).select("hash"), "hash", "left_anti"))
        found = settled(parse_messages(split_conversations(parsed_lines(lines.join(new.select("file_path"), "file_path", "left_semi")))))
        write(found, number)
        given = found.groupBy("file_path").agg(F.countDistinct("conversation").alias("conversations"))
        self.table.write(new.join(given, "file_path").select("hash", F.col("file_path").alias("path"), "conversations"), number)

    def on_batch(self, write: Write, glob: str = "*.jsonl") -> Write:
        """The foreachBatch function of a stream of lines (stream_lines): its files, at most those of one trigger, are read as a whole."""

        def run(batch: DataFrame, number: int) -> None:
            paths = [r.file_path for r in batch.select("file_path").distinct().collect()]
            if paths:
                self.process(numbered_lines(self.spark, paths, glob), number, write)

        return run

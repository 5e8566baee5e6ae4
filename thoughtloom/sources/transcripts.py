"""Reading transcripts: JSON lines of coding-assistant sessions to messages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import settled

BLOCK = "struct<type: string, text: string, thinking: string, id: string, name: string, input: map<string, string>, tool_use_id: string, content: string>"
LINE = "type string, timestamp string, message struct<role: string, content: string>, role string, content string"
#: The parameter of a tool call that is shown, first found.
SHOWN = ["command", "file_path", "path", "pattern", "query"]


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """(file_path, size, modified, line, raw) of all files below path, of any size: no file is ever in one row or one task.

    Files are read in splits. Lines of a split come in their order, so each task numbers those of its splits; the lines
    before a split are the sum of its file's earlier splits' counts, a table of one row a split. Paths with `subagents`
    are left out.
    """
    meta = F.col("_metadata")
    text = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = text.select(meta["file_path"].alias("file_path"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"), meta["file_block_start"].alias("start"), F.col("value").alias("raw"))
    text = text.where(~F.contains("file_path", F.lit("subagents")))
    counts = settled(text.groupBy("file_path", "start").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file_path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def number(batches):
        import pyarrow as pa

        seen: dict[tuple, int] = {}
        for b in batches:
            keys = zip(b.column("file_path").to_pylist(), b.column("start").to_pylist())
            places = []
            for key in keys:
                places.append(seen.get(key, 0))
                seen[key] = places[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], names=[*b.schema.names, "place"])

    placed = text.mapInArrow(number, "file_path string, size bigint, modified timestamp, start bigint, raw string, place bigint")
    # a checked size: one short row for each split, some tens of MB at most; beyond it the join shuffles
    offsets = F.broadcast(offsets) if counts.count() <= 200_000 else offsets
    return placed.join(offsets, ["file_path", "start"]).select("file_path", "size", "modified", (F.col("offset") + F.col("place")).alias("line"), "raw")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(file_path, size, modified, line, raw, type, ts, role, content) of lines that are JSON records; blank ones are left out."""
    parsed = lines.where(F.length(F.trim("raw")) > 0).withColumn("r", F.from_json("raw", LINE, {"mode": "PERMISSIVE"})).where(F.try_parse_json("raw").isNotNull() & F.col("r").isNotNull())
    role = F.coalesce("r.message.role", "r.role", F.when(F.col("r.type").isin("user", "assistant", "system"), F.col("r.type")))
    return parsed.select("file_path", "size", "modified", "line", "raw", "r.type", F.col("r.timestamp").alias("ts"), role.alias("role"), F.coalesce("r.message.content", "r.content").alias("content"))


def read_transcripts(spark: SparkSession, path: str, project: str | None = None, exclude: tuple[str, ...] = (), glob: str = "*.jsonl") -> DataFrame:
    """(file_path, project, size, modified, line, record fields) of the transcripts below path, by the project of their directory."""
    lines = parsed_lines(numbered_lines(spark, path, glob)).withColumn("directory", F.element_at(F.split("file_path", "/"), -2))
    lines = filter_projects(lines, project, exclude)
    return lines.select("file_path", project_from_path(F.col("directory")).alias("project"), "size", "modified", "line", "type", "ts", "role", "content")


def content_hashes(lines: DataFrame, chunk: int = 10_000) -> DataFrame:
    """(file_path, hash): equal for files of equal lines (file_path, line, raw). Chunks of lines are hashed first, then a file's chunks."""
    joined = lambda c, order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda x: x["h"]), "\n")
    h = lines.select("file_path", "line", F.sha2("raw", 256).alias("h"), F.floor(F.col("line") / chunk).alias("chunk"))
    h = h.groupBy("file_path", "chunk").agg(F.sha2(joined("h", "line"), 256).alias("h"))
    return h.groupBy("file_path").agg(F.sha2(joined("h", "chunk"), 256).alias("hash"))


def project_from_path(c: Column) -> Column:
    """Directory parts split at -: more than three give those after the third, three give the last, else the directory."""
    p = F.split(c, "-")
    return F.when(F.size(p) > 3, F.array_join(F.slice(p, 4, 1 << 20), "-")).when(F.size(p) == 3, F.element_at(p, 3)).otherwise(c)


def filter_projects(df: DataFrame, include: str | None = None, exclude: tuple[str, ...] = (), directory: str = "directory") -> DataFrame:
    c = F.lower(directory)
    if include:
        df = df.where(F.contains(c, F.lit(include.lower())))
    for x in exclude:
        df = df.where(~F.contains(c, F.lit(x.lower())))
    return df


def new_files(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files (path, hash) whose content hash is not among processed (hash), one path for each hash."""
    return files.groupBy("hash").agg(F.min("path").alias("path")).join(processed.select("hash").distinct(), "hash", "left_anti")


def blocks_of(content: Column) -> Column:
    """Content as blocks: JSON lists are parsed, anything else is one text block."""
    parsed = F.from_json(content, f"array<{BLOCK}>")
    text = F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))), f"array<{BLOCK}>")
    return F.when(F.startswith(F.trim(content), F.lit("[")) & parsed.isNotNull(), parsed).otherwise(text)


def flatten_blocks(blocks: Column) -> Column:
    """Text blocks joined without a separator, tool calls as [Tool: Name(parameter)]; thinking and results are left out."""
    shown = lambda b: F.coalesce(*[F.element_at(b["input"], k) for k in SHOWN], F.lit(""))
    piece = lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"] == "tool_use", F.concat(F.lit("[Tool: "), b["name"], F.lit("("), F.substring(shown(b), 1, 80), F.lit(")]"))).otherwise("")
    return F.array_join(F.transform(blocks, piece), "")


def parse_messages(lines: DataFrame) -> DataFrame:
    """(file_path, line, turn_index, role, content, thinking, tool_calls) of user and assistant lines; empty messages are dropped.

    Turns count within a file, or within a conversation where lines have one (split_conversations).
    """
    where = ["file_path", *(c for c in ("conversation",) if c in lines.columns)]
    m = lines.where(F.col("role").isNotNull() & F.col("content").isNotNull()).withColumn("b", blocks_of(F.col("content")))
    thought = F.array_join(F.transform(F.filter("b", lambda b: b["type"] == "thinking"), lambda b: b["thinking"]), "\n\n")
    calls = F.transform(F.filter("b", lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["name"].alias("name"), b["input"].alias("input"), b["id"].alias("tool_use_id")))
    m = m.select(*where, "line", "ts", "role", flatten_blocks(F.col("b")).alias("content"), F.when(thought != "", thought).alias("thinking"), calls.alias("tool_calls"), F.transform(F.filter("b", lambda b: b["type"] == "tool_result"), lambda b: F.struct(b["tool_use_id"].alias("tool_use_id"), b["content"].alias("result"))).alias("results"))
    kept = m.where((F.length(F.trim("content")) > 0) | F.col("thinking").isNotNull() | (F.size("tool_calls") > 0))
    return kept.withColumn("turn_index", F.row_number().over(Window.partitionBy(*where).orderBy("line")) - 1)


def split_conversations(lines: DataFrame) -> DataFrame:
    """lines with conversation (ordinal in the file) and turn_index, cut after each conversation_end line."""
    w = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    n = lines.withColumn("conversation", F.coalesce(F.sum((F.col("type") == "conversation_end").cast("int")).over(w), F.lit(0)))
    n = n.where("type <> 'conversation_end' OR type IS NULL")
    return n.withColumn("turn_index", F.row_number().over(Window.partitionBy("file_path", "conversation").orderBy("line")) - 1)


def attach_tool_results(messages: DataFrame) -> DataFrame:
    """(file_path, line, name, tool_use_id, result): each call with the first later result of its id."""
    calls = messages.select("file_path", "line", F.explode("tool_calls").alias("c")).select("file_path", "line", "c.name", "c.tool_use_id")
    results = messages.select("file_path", F.col("line").alias("at"), F.explode("results").alias("r")).select("file_path", "at", "r.tool_use_id", "r.result")
    j = calls.join(results, ["file_path", "tool_use_id"], "left").where("at IS NULL OR at > line")
    return j.groupBy("file_path", "line", "name", "tool_use_id").agg(F.min(F.struct("at", "result"))["result"].alias("result"))


def conversation_text(messages: DataFrame, by: str = "conv_id", structured: bool = False) -> DataFrame:
    """(by, text): `role: content` joined by blank lines; structured adds turn headers."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("content"))
    if structured:
        line = F.concat(F.lit("[Turn "), F.col("turn_index").cast("string"), F.lit("] "), line)
    rows = F.sort_array(F.collect_list(F.struct("turn_index", line.alias("line"))))
    return messages.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n\n").alias("text"))


def list_projects(df: DataFrame) -> DataFrame:
    return df.groupBy("project").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("conversations"))


def previews(conversations: DataFrame, n: int = 10, chars: int = 300) -> DataFrame:
    """The first n conversations by id with the start of their text."""
    return conversations.orderBy("conv_id").limit(n).select("conv_id", F.substring("text", 1, chars).alias("preview"))


def bulk_import(new: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, (outcome, n)): new rows (pos, user_id, trigger, agent_decision, confidence) that are valid and not there yet, the first of equals by pos."""
    key = ["user_id", "trigger", "agent_decision"]
    ok = (F.length(F.trim(F.coalesce("trigger", F.lit("")))) > 0) & (F.length(F.trim(F.coalesce("agent_decision", F.lit("")))) > 0) & F.coalesce(F.col("confidence").between(0, 1), F.lit(True))
    judged = new.withColumn("ok", ok)
    good = judged.where("ok").withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    there = decisions.select(*key, F.lit(True).alias("_there")).distinct()
    cond = [good[k].eqNullSafe(there[k]) for k in key]
    marked = good.join(there, cond[0] & cond[1] & cond[2], "left").select(good["*"], F.col("_there"))
    add = marked.where("_r = 1 AND _there IS NULL").select(*new.columns)
    outcome = marked.select(F.when((F.col("_r") == 1) & F.col("_there").isNull(), "imported").otherwise("skipped").alias("outcome")).unionByName(judged.where(~F.col("ok")).select(F.lit("error").alias("outcome")))
    return add, outcome.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))

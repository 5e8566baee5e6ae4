"""Queries of resolution by tenant, stored indexes, streams and transcripts, each beside its SQL where SQL can say it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import scratch, settled
from ..operators import extraction as X
from ..operators import integrity as V
from ..operators import resolve as E
from ..operators import rules as R
from ..operators import search as S
from ..operators import text_index
from ..sources import sinks, transcripts
from ..streaming import fanout, queue, registry
from ..streaming import streams as W
from . import bindings as B
from .bindings import sql
from .more_queries import _LCS
from .queries import joined, query

# ---- resolution by stage, tenant, type and vector

_KINDS = ["technology", "concept", "pattern", "system", "person", "organization", "file", "other"]


def _stores(s, d):
    """Two entities for each name, of two tenants where their labels differ in parity."""
    e = B.table(s, d, "embeddings")
    name = F.concat(F.lit("store "), F.substring(F.md5(F.floor(F.col("vec_id") / 2).cast("string")), 1, 8))
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("user_id"), name.alias("name"), "embedding")


def _named(s, d):
    """Names in capitals, misspelt ones, and unknown ones with a vector that lost up to 22 of its entries."""
    e = _stores(s, d)
    kind = F.col("id") % 4
    mention = F.when(kind == 0, F.upper("name")).when(kind == 1, F.concat("name", F.lit("s"))).when(kind == 2, F.concat(F.lit("unseen "), F.md5(F.col("id").cast("string"))))
    other = F.concat(F.lit("nothing "), F.sha1(F.col("id").cast("string")))
    kinds = F.element_at(F.array(*map(F.lit, _KINDS)), (F.floor(F.col("id") / 4) % 8 + 1).cast("int"))
    vector = F.when(kind == 2, F.transform("embedding", lambda x, i: F.when(i < F.col("id") % 24, F.lit(0.0).cast("float")).otherwise(x)))
    return e.select("id", F.coalesce(mention, other).alias("mention"), kinds.alias("type"), vector.alias("embedding"))


_STORES = f"""e AS (SELECT vec_id AS id, label % 2 AS user_id, 'store ' || substr(md5(CAST(vec_id // 2 AS VARCHAR)), 1, 8) AS name, embedding FROM embeddings),
    asked AS (SELECT id, CASE id % 4 WHEN 0 THEN upper(name) WHEN 1 THEN name || 's' WHEN 2 THEN 'unseen ' || md5(CAST(id AS VARCHAR)) ELSE 'nothing ' || sha1(CAST(id AS VARCHAR)) END AS mention,
      {_KINDS}[(id // 4) % 8 + 1] AS type, CASE WHEN id % 4 = 2 THEN list_transform(embedding, lambda x, i: CASE WHEN i <= id % 24 THEN 0 ELSE x END) END AS embedding FROM e),
    m AS (SELECT mention, type, min(embedding) AS embedding FROM asked GROUP BY 1, 2),
    least AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {100 * t}, {v})" for k, (t, v) in E.THRESHOLDS.items())}, ('other', 85, 0.9)) t(type, name_least, cosine_least))"""

query(
    "e03_resolution_tenants",
    f"""WITH {_STORES},
    exact AS (SELECT mention, type, e.id, row_number() OVER (PARTITION BY mention, type ORDER BY e.user_id IS DISTINCT FROM 1, e.id) AS r FROM m JOIN e ON e.name = lower(mention)),
    near AS (SELECT mention, type, id, 2 * {_LCS} / (length(a) + length(b)) AS score, user_id, name_least FROM
      (SELECT mention, type, lower(mention) AS a, e.name AS b, e.id, e.user_id, name_least FROM m JOIN least USING (type) JOIN e ON levenshtein(lower(mention), e.name) <= 0.25 * (length(mention) + length(e.name)))),
    fuzzy AS (SELECT mention, type, id, score, row_number() OVER (PARTITION BY mention, type ORDER BY user_id IS DISTINCT FROM 1, score DESC, id) AS r FROM near WHERE 100 * score >= name_least - 1e-9),
    close AS (SELECT mention, type, e.id, e.user_id, list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score, cosine_least FROM m JOIN least USING (type), e WHERE m.embedding IS NOT NULL),
    vector AS (SELECT mention, type, id, score, row_number() OVER (PARTITION BY mention, type ORDER BY user_id IS DISTINCT FROM 1, score DESC, id) AS r FROM close WHERE score > cosine_least)
    SELECT mention, type, coalesce(x.id, f.id, v.id) AS id,
      CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN f.id IS NOT NULL THEN 'fuzzy' WHEN v.id IS NOT NULL THEN 'embedding' ELSE 'new' END AS method,
      round(CASE WHEN x.id IS NOT NULL THEN 1 WHEN f.id IS NOT NULL THEN f.score WHEN v.id IS NOT NULL THEN v.score ELSE 1 END, 6) AS score
    FROM m LEFT JOIN (SELECT * FROM exact WHERE r = 1) x USING (mention, type) LEFT JOIN (SELECT * FROM fuzzy WHERE r = 1) f USING (mention, type) LEFT JOIN (SELECT * FROM vector WHERE r = 1) v USING (mention, type)""",
)(
    lambda s, d: E.resolve_entities(_named(s, d), _stores(s, d), s.createDataFrame([], "alias string, canonical string"), None, 1).withColumn("score", F.round("score", 6))
)

query(
    "e08_embedding_by_type",
    f"""WITH {_STORES}, p AS (SELECT q.id AS query, e.id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s, cosine_least FROM asked q JOIN least USING (type), e WHERE q.embedding IS NOT NULL)
    SELECT query, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS r FROM p WHERE s > cosine_least) WHERE r = 1""",
)(lambda s, d: E.match_embedding(_named(s, d).where("embedding IS NOT NULL").withColumn("id", F.col("id") + 1_000_000_000), _stores(s, d), None).select((F.col("query") - 1_000_000_000).alias("query"), "id", F.round("score", 6).alias("score")))

# ---- the stored index of both kinds


def _phrases(s, d):
    """Priorities, parts of segments (which only substrings meet), and names of entities."""
    found = [
        B.table(s, d, "orders").select(F.lower("o_orderpriority").alias("text")),
        B.table(s, d, "customer").select(F.lower(F.substring("c_mktsegment", 2, 4)).alias("text")),
        B.table(s, d, "part").select(F.lower("p_name").alias("text")),
    ]
    return found[0].union(found[1]).union(found[2]).distinct().select(F.col("text").alias("id"), "text")


def _search_kinds(s, d):
    """Both indexes made of half the rows, then extended by the other half."""
    decisions = text_index.TextIndex(s, scratch(s, "decision-index"), ["trigger", "context", "agent_decision", "agent_rationale"])
    entities = text_index.TextIndex(s, scratch(s, "entity-index"), ["name"])
    for part in (0, 1):
        decisions.add(B.decisions(s, d).where(F.col("id") % 2 == part), part)
        entities.add(B.entities(s, d).where(F.col("id") % 2 == part), part)
    return S.search_kinds(_phrases(s, d), decisions, entities).withColumn("score", F.round("score", 6))


_BM25_KIND = r"""{k}t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM {k}), {k}tf AS (SELECT id, term, count(*) AS tf FROM {k}t GROUP BY 1, 2),
    {k}l AS (SELECT id, count(*) AS l FROM {k}t GROUP BY 1), {k}df AS (SELECT term, count(*) AS df FROM {k}tf GROUP BY 1), {k}st AS (SELECT (SELECT count(*) FROM {k}) AS n, (SELECT avg(l) FROM {k}l) AS mean),
    {k}s AS (SELECT query, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS s FROM q JOIN {k}tf USING (term) JOIN {k}df USING (term) JOIN {k}l USING (id), {k}st GROUP BY 1, 2),
    {k}b AS (SELECT query, id, s FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS r FROM {k}s) WHERE r <= 20),
    {k}u AS (SELECT p.id AS query, x.id, 1.0 AS s FROM phrases p JOIN {k} x ON contains(lower(x.text), p.text) WHERE p.id NOT IN (SELECT query FROM {k}b) QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY x.id DESC) <= 20)"""
query(
    "s06_kinds",
    sql(
        rf""", dx AS (SELECT id, concat_ws(chr(10), trigger, context, agent_decision, agent_rationale) AS text FROM decisions), ex AS (SELECT id, name AS text FROM entities),
    phrases AS (SELECT text AS id, text FROM (SELECT lower(o_orderpriority) AS text FROM orders UNION SELECT lower(substr(c_mktsegment, 2, 4)) FROM customer UNION SELECT lower(p_name) FROM part)),
    q AS (SELECT DISTINCT id AS query, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS term FROM phrases), {_BM25_KIND.format(k="dx")}, {_BM25_KIND.format(k="ex")}
    SELECT query, 'decision' AS kind, id, round(s, 6) AS score FROM (SELECT * FROM dxb UNION ALL SELECT * FROM dxu) UNION ALL SELECT query, 'entity', id, round(s, 6) FROM (SELECT * FROM exb UNION ALL SELECT * FROM exu)""",
        "decisions", "entities",
    ),
)(_search_kinds)

# ---- saving decisions batch by batch


def _saved(s, d):
    """Orders as decisions to save: files and entities of their lines, and a vector of their customer's that lost some entries."""
    lines = B.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_suppkey").repartition("id").groupBy("id")
    lines = lines.agg(F.collect_set("l_partkey").alias("entities"), F.collect_set(F.concat(F.lit("f"), F.col("l_suppkey").cast("string"))).alias("files"))
    # at most 250 vectors are met, so decisions need not be dealt by them
    vectors = F.broadcast(B.table(s, d, "embeddings").where("abs(vec_id) < 250").select(F.col("vec_id").alias("v"), "embedding"))
    o = B.decisions(s, d).join(lines, "id", "left").join(vectors, F.col("user_id") % 250 == F.col("v"), "left")
    vector = F.transform("embedding", lambda x, i: F.when(i < F.col("id") % 24, F.lit(0.0).cast("float")).otherwise(x))
    options = F.array(F.coalesce("agent_decision", F.lit("none")), F.concat(F.lit("Hold order "), F.col("id").cast("string")), F.lit("no"))
    created = F.col("created_at").cast("timestamp_ntz")
    return o.select("id", "user_id", "project_name", created.alias("created_at"), "turn_index", "agent_decision", options.alias("options"), "files", "entities", vector.alias("embedding"))


def _fanout(s, d):
    """The orders in three batches by time; all derived edges in one table."""
    store = fanout.SavedDecisions(s, scratch(s, "saved"))
    saved = _saved(s, d)
    cuts = [None, "1995-01-01", "1997-06-01", None]
    for k in range(3):
        part = saved
        if cuts[k]:
            part = part.where(F.col("created_at") >= F.lit(cuts[k]).cast("timestamp_ntz"))
        if cuts[k + 1]:
            part = part.where(F.col("created_at") < F.lit(cuts[k + 1]).cast("timestamp_ntz"))
        store.save(part, k)
    row = lambda kind, src, dst, note: F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.cast("string").alias("dst"), note.cast("string").alias("note"))
    c = F.col
    tables = {
        "candidates": row("candidate", c("decision_id"), c("text"), F.lit("")),
        "similar": row("similar", c("src"), c("dst"), c("tier")),
        "influenced": row("influenced", c("src"), c("dst"), c("shared")),
        "temporal": row("temporal", c("src"), c("dst"), c("rel")),
        "affects": row("affects", c("src"), c("dst"), F.lit("1")),
        "reviews": row("review", c("id"), c("other"), c("rank")),
    }
    out = None
    for name, x in tables.items():
        found = store.read(name).select(x.alias("x")).select("x.*")
        out = found if out is None else out.unionByName(found)
    return out


query(
    "w09_save_fanout",
    sql(
        f""", l AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS e FROM lineitem),
    v AS (SELECT d.id, d.user_id, d.created_at, list_transform(embedding, lambda x, i: CASE WHEN i <= d.id % 24 THEN 0 ELSE x END) AS embedding FROM decisions d JOIN embeddings ON vec_id = d.user_id % 250),
    sim AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM v a JOIN v b ON a.user_id = b.user_id AND (b.created_at, b.id) < (a.created_at, a.id)),
    best AS (SELECT * FROM sim WHERE s > 0.85 QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, dst) <= 5),
    sh AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM l x JOIN l y ON x.e = y.e AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2),
    inf AS (SELECT CASE WHEN p.created_at > q.created_at THEN a ELSE b END AS src, CASE WHEN p.created_at > q.created_at THEN b ELSE a END AS dst, n FROM sh JOIN decisions p ON p.id = a JOIN decisions q ON q.id = b WHERE p.created_at <> q.created_at),
    tmp AS (SELECT a.id AS src, b.id AS dst FROM decisions a JOIN decisions b ON a.user_id = b.user_id AND a.project_name = b.project_name AND a.turn_index > b.turn_index),
    rev AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id DESC) AS r FROM decisions a JOIN decisions b ON a.project_name = b.project_name AND a.user_id <> b.user_id AND (b.created_at, b.id) < (a.created_at, a.id))
    SELECT 'candidate' AS kind, id AS src, 'Hold order ' || id AS dst, '' AS note FROM decisions UNION ALL SELECT 'candidate', id, 'none', '' FROM decisions WHERE agent_decision IS NULL
    UNION ALL SELECT 'similar', src, CAST(dst AS VARCHAR), CASE WHEN s >= 0.9 THEN 'high' ELSE 'moderate' END FROM best
    UNION ALL SELECT 'influenced', src, CAST(dst AS VARCHAR), CAST(n AS VARCHAR) FROM inf
    UNION ALL SELECT 'temporal', src, CAST(dst AS VARCHAR), 'FOLLOWS' FROM tmp UNION ALL SELECT 'temporal', dst, CAST(src AS VARCHAR), 'PRECEDES' FROM tmp
    UNION ALL SELECT DISTINCT 'affects', l_orderkey, 'f' || l_suppkey, '1' FROM lineitem
    UNION ALL SELECT 'review', src, CAST(dst AS VARCHAR), CAST(r AS VARCHAR) FROM rev WHERE r <= 20""",
        "decisions",
    ),
)(_fanout)

# ---- messages, files and transcripts


def _ran(stream: DataFrame, path: str, save) -> None:
    stream.writeStream.foreachBatch(save).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start().awaitTermination()


def _message_batches(s, d):
    """All messages through the queue, every session flushed at the end."""
    path = scratch(s, "queue")
    messages = B.table(s, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("bigint").alias("id"), "role", F.col("text").alias("content"))
    messages.coalesce(1).write.parquet(f"{path}/messages")
    messages.select("session").distinct().coalesce(1).write.parquet(f"{path}/requests")
    read = lambda name, schema: s.readStream.schema(schema).parquet(f"{path}/{name}")
    heard = queue.queued(read("messages", queue.MESSAGE), read("requests", "session bigint"))
    total, stored = messages.count(), {}

    def save(rows, n):
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        stored[n] = s.read.parquet(f"{path}/out/batch={n}").count()

    # a stream with timers by the clock does not end by itself
    q = queue.flushes(heard).writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").start()
    end = time.time() + 600
    while sum(stored.values()) < total and time.time() < end and q.exception() is None:
        time.sleep(0.2)
    q.stop()
    if q.exception() is not None or sum(stored.values()) < total:
        raise RuntimeError(f"{sum(stored.values())} of {total} messages were flushed: {q.exception()}")
    found = s.read.schema(queue.FLUSHED).parquet(f"{path}/out/batch=*")
    return found.groupBy("session", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


query(
    "w03_message_batches",
    "SELECT session, batch, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT conv_id AS session, turn AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 10 AS batch FROM conversations) GROUP BY 1, 2",
)(_message_batches)


def _record(role="role", content="text"):
    return F.to_json(F.struct(F.col(role).alias("type"), F.struct(F.col(role).alias("role"), F.col(content).alias("content")).alias("message")))


def _transcripts(s, d, lines: DataFrame) -> str:
    """lines (project, place, raw) written as files, one for each project, in the order of place; blank and broken lines between."""
    path = scratch(s, "transcripts")
    lines.repartition("project").sortWithinPartitions("project", "place").select("project", "raw").write.partitionBy("project").text(path)
    return path


def _spoken(s, d) -> DataFrame:
    """Turns as lines: a conversation's last one is followed by its end, every seventh by a line that is no JSON."""
    c = B.table(s, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    end = F.when(F.col("turn") == F.col("last"), F.array(F.lit('{"type": "conversation_end"}'))).otherwise(F.array().cast("array<string>"))
    broken = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.array(F.lit("{broken"), F.lit("  "))).otherwise(F.array().cast("array<string>"))
    rows = c.where("text IS NOT NULL AND role IS NOT NULL").join(last, "conv_id").withColumn("raw", F.explode(F.concat(F.array(_record()), broken, end)))
    return rows.select(F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project"), F.struct("conv_id", "turn", F.when(F.startswith("raw", F.lit('{"type":"conversation_end')), 3).when(F.startswith("raw", F.lit("{b")), 1).when(F.trim("raw") == "", 2).when(F.col("raw") == '{"type": "conversation_end"}', 3).otherwise(0).alias("k")).alias("place"), "raw")


_LINES = """c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, conv_id % 5 AS p FROM conversations), u AS (SELECT * FROM c WHERE text IS NOT NULL AND role IS NOT NULL),
    k AS (SELECT p, conv_id, turn, 0 AS k, role, text FROM u UNION ALL SELECT p, conv_id, turn, 1, NULL, NULL FROM u WHERE (conv_id + turn) % 7 = 0 UNION ALL SELECT p, conv_id, turn, 2, NULL, NULL FROM u WHERE (conv_id + turn) % 7 = 0 UNION ALL SELECT p, conv_id, turn, 3, NULL, NULL FROM u WHERE turn = last),
    n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY conv_id, turn, k) - 1 AS line FROM k)"""
query(
    "src1_transcript_scan",
    f"WITH {_LINES} SELECT 'project=p' || p AS project, line, role, md5(text) AS text FROM n WHERE k = 0",
)(
    lambda s, d: transcripts.read_transcripts(s, _transcripts(s, d, _spoken(s, d)), glob="*.txt").where("role IS NOT NULL").select("project", "line", "role", F.md5("content").alias("text"))
)
query(
    "src3_project_filter",
    f"WITH {_LINES} SELECT 'project=p' || p AS project, count(*) AS n FROM n WHERE k = 0 AND p NOT IN (2, 3) GROUP BY 1",
)(
    lambda s, d: transcripts.read_transcripts(s, _transcripts(s, d, _spoken(s, d)), project="PROJECT=", exclude=("P2", "p3"), glob="*.txt").where("role IS NOT NULL").groupBy("project").agg(F.count(F.lit(1)).alias("n"))
)


def _ledger(s, d):
    """The files of the conversations in two batches: the second one brings the first one's content again under other names."""
    ledger, path = registry.FileLedger(s, scratch(s, "ledger")), _transcripts(s, d, _spoken(s, d))
    lines = settled(transcripts.numbered_lines(s, path, "*.txt").withColumn("p", F.regexp_extract("file_path", "project=(p[0-9]+)", 1)))
    again = lambda name: lines.withColumn("file_path", F.concat(F.lit(f"{name}/"), F.col("p"))).drop("p")
    ledger.process(again("first").where("file_path < 'first/p3'"), 0, lambda df, n: None)
    ledger.process(again("second"), 1, lambda df, n: None)
    return ledger.table.read().select("path", "conversations", F.col("batch").cast("bigint").alias("batch"))


query(
    "w02_file_ledger",
    f"WITH {_LINES} SELECT CASE WHEN p < 3 THEN 'first/p' ELSE 'second/p' END || p AS path, count(DISTINCT conv_id) AS conversations, CASE WHEN p < 3 THEN 0 ELSE 1 END AS batch FROM n WHERE k = 0 GROUP BY p",
)(_ledger)


def _blocks(s, d):
    """Turns as content blocks: text with thinking, then a tool call whose result is in the conversation's next turn."""
    c = B.table(s, d, "conversations").where("text IS NOT NULL AND role IS NOT NULL")
    key = F.concat_ws("-", "conv_id", "turn")
    block = lambda **v: F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(n) for n, x in v.items()])
    shared = {n: F.lit(None).cast("string") for n in ("text", "thinking", "id", "name", "tool_use_id", "content")}
    none = F.lit(None).cast("map<string,string>")
    kinds = [
        {"type": "thinking", "thinking": F.concat(F.lit("on "), key)},
        {"type": "text", "text": F.col("text")},
        {"type": "tool_use", "id": key, "name": "Read", "input": F.create_map(F.lit("path"), F.concat(F.lit("src/"), key))},
        {"type": "tool_result", "tool_use_id": F.concat_ws("-", "conv_id", (F.col("turn") - 1).cast("string")), "content": F.concat(F.lit("result "), key)},
    ]
    content = F.to_json(F.array(*[block(**{"type": k["type"], **shared, "input": none, **k}) for k in kinds]))
    return c.select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").cast("bigint").alias("line"), F.lit(None).cast("string").alias("ts"), "role", content.alias("content"))


_KEPT = "t AS (SELECT * FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)"
query(
    "src5_block_flattening",
    f"WITH {_KEPT} SELECT conv_id || '-' || turn AS id, md5(text || '[Tool: Read(src/' || conv_id || '-' || turn || ')]') AS text FROM t",
)(lambda s, d: _blocks(s, d).select(F.concat_ws("-", "file_path", "line").alias("id"), F.md5(transcripts.flatten_blocks(transcripts.blocks_of(F.col("content")))).alias("text")))
query(
    "src6_message_parse",
    f"WITH {_KEPT} SELECT CAST(conv_id AS VARCHAR) AS file_path, turn AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, role, 'on ' || conv_id || '-' || turn AS thinking, 'Read' AS calls FROM t",
)(lambda s, d: transcripts.parse_messages(_blocks(s, d)).select("file_path", "line", F.col("turn_index").cast("bigint").alias("turn_index"), "role", "thinking", joined(F.transform("tool_calls", lambda c: c["name"]), "calls")))
query(
    "src8_tool_results",
    f"WITH {_KEPT} SELECT CAST(a.conv_id AS VARCHAR) AS file_path, a.turn AS line, 'Read' AS name, CASE WHEN b.turn IS NULL THEN NULL ELSE 'result ' || b.conv_id || '-' || b.turn END AS result FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1",
)(lambda s, d: transcripts.attach_tool_results(transcripts.parse_messages(_blocks(s, d))).select("file_path", "line", "name", "result"))


def _csv(s, d):
    path = scratch(s, "csv")
    sinks.export_csv(B.decisions(s, d).select("id", "project_name", "trigger", "agent_decision").withColumn("entities", F.array().cast("array<struct<id:bigint,name:string,type:string>>")), path)
    found = s.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    return found.select(F.col("id").cast("bigint").alias("id"), "trigger")


query("snk2_csv_export", sql("SELECT id, trigger FROM decisions", "decisions"))(_csv)


def _once(s, d):
    """Notifications of all customers' orders, each said three times, through the stream."""
    path = scratch(s, "notices")
    o = B.table(s, d, "orders").select(F.lit("stale_decision").alias("type"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("subject"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    o.withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2))))).drop("k").coalesce(2).write.parquet(f"{path}/in")
    stream = s.readStream.schema(o.schema).parquet(f"{path}/in")
    _ran(W.notify_once(stream), path, lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
    return s.read.schema(o.schema).parquet(f"{path}/out/batch=*").select("type", "user_id", "subject")


query("w10_notify_once", "SELECT 'stale_decision' AS type, o_custkey AS user_id, o_orderkey AS subject FROM orders")(_once)


def _streamed(s, d):
    """Lines of transcripts as a stream of files; blank ones stay out."""
    path = scratch(s, "stream")
    files = _transcripts(s, d, _spoken(s, d))
    _ran(W.stream_lines(s, files, glob="*.txt"), path, lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
    found = s.read.schema("file_path string, modified timestamp, value string").parquet(f"{path}/out/batch=*")
    return found.groupBy(F.regexp_extract("file_path", "project=(p[0-9]+)", 1).alias("project")).agg(F.count(F.lit(1)).alias("n"))


query("w01_transcript_stream", f"WITH {_LINES} SELECT 'p' || p AS project, count(*) AS n FROM n WHERE k <> 2 GROUP BY 1")(_streamed)

# ---- cycles of every depth, dormancy by edges, removal of a project


def _rings(s, d):
    """Each customer's orders in the order of time as one ring; every seventh key has a chord to the order after the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = B.table(s, d, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("next"), F.lead("o_orderkey", 2).over(w).alias("chord"), F.first("o_orderkey").over(whole).alias("first"))
    ring = o.select("src", F.coalesce("next", "first").alias("dst"))
    return ring.union(o.where("src % 7 = 0 AND chord IS NOT NULL").select("src", "chord"))


_RINGS = """o AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER w AS next, lead(o_orderkey, 2) OVER w AS chord, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    e AS (SELECT src, coalesce(next, first) AS dst FROM o UNION SELECT src, chord FROM o WHERE src % 7 = 0 AND chord IS NOT NULL)"""
query(
    "v01_ring_cycles",
    f"""WITH RECURSIVE {_RINGS}, w AS (SELECT src AS first, dst AS at, [src, dst] AS nodes FROM e WHERE dst > src UNION ALL SELECT first, e.dst, list_append(nodes, e.dst) FROM w JOIN e ON e.src = w.at WHERE e.dst > first AND NOT list_contains(nodes, e.dst) AND len(nodes) < 20)
    SELECT min(array_to_string(nodes, ',')) AS nodes, len(min(nodes)) AS length FROM w JOIN e ON e.src = w.at AND e.dst = w.first GROUP BY list_sort(nodes)""",
)(lambda s, d: V.find_cycles(_rings(s, d), 20, None).select(joined("nodes", "nodes"), F.col("length").cast("bigint").alias("length")))


def _dormant(s, d):
    """Options of a customer's orders: texts of his priorities; an order FOLLOWS the two orders around it."""
    c = B.decisions(s, d).withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("agent_decision", F.lower(F.substring("trigger", 15, 60)))
    options = F.array(F.col("agent_decision"), F.upper(F.substring("trigger", 22, 6)), F.concat(F.lit("never "), F.col("scope")))
    candidates = R.rejected_candidates(c.withColumn("options", options))
    old = B.supersedes(s, d)
    follows = old.where("src % 3 = 0").unionByName(old.where("src % 3 = 1").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = R.dormant_alternatives(candidates, c, B.as_of(), limit=None, follows=follows)
    return found.select("decision_id", "text", "days")


query(
    "r02_dormant_by_follows",
    sql(
        f""", x AS (SELECT id, user_id, created_at, lower(substr(trigger, 15, 60)) AS chosen, scope, trigger FROM decisions),
    c AS (SELECT id, user_id, created_at, upper(substr(trigger, 22, 6)) AS text FROM x WHERE length(trim(substr(trigger, 22, 6))) >= 3 AND lower(trim(substr(trigger, 22, 6))) <> trim(chosen) UNION ALL SELECT id, user_id, created_at, 'never ' || scope FROM x),
    f AS (SELECT src, dst FROM supersedes WHERE src % 3 = 0 UNION ALL SELECT dst, src FROM supersedes WHERE src % 3 = 1),
    ahead AS (SELECT DISTINCT f.src FROM f JOIN x a ON a.id = f.src JOIN x b ON b.id = f.dst WHERE b.created_at > a.created_at)
    SELECT id AS decision_id, trim(text) AS text, date_diff('day', created_at, TIMESTAMP '{B.AS_OF}') AS days FROM c
    WHERE created_at <= TIMESTAMP '{B.AS_OF}' - INTERVAL 14 DAY AND (id NOT IN (SELECT src FROM ahead) OR NOT EXISTS (SELECT 1 FROM x l WHERE l.user_id = c.user_id AND l.created_at > c.created_at AND l.chosen <> '' AND (contains(l.chosen, lower(trim(c.text))) OR contains(lower(trim(c.text)), l.chosen))))""",
        "decisions", "supersedes",
    ),
)(_dormant)
query(
    "v11_delete_project",
    sql(
        """, g AS (SELECT id FROM decisions WHERE project_name = 'BUILDING'), k AS (SELECT id FROM entities WHERE id IN (SELECT dst FROM involves WHERE src NOT IN (SELECT id FROM g)))
    SELECT src, dst, rel FROM edges WHERE CASE WHEN rel = 'RELATED_TO' THEN src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) WHEN rel = 'INVOLVES' THEN src NOT IN (SELECT id FROM g) ELSE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g) END""",
        "decisions", "entities", "edges",
    ),
)(lambda s, d: V.delete_project(B.decisions(s, d), B.entities(s, d), B.edges(s, d), "BUILDING")[2].select("src", "dst", "rel"))

# ---- notices, answers as lists, packs with entities and chains

query(
    "r13_stale_notices",
    sql(
        f""", x AS (SELECT *, date_diff('second', coalesce(last_reviewed_at, created_at), TIMESTAMP '{B.AS_OF}') // 86400 AS days, CASE scope WHEN 'strategic' THEN 730 WHEN 'library' THEN 90 WHEN 'config' THEN 30 WHEN 'operational' THEN 14 ELSE 90 END AS most FROM decisions)
    SELECT 'stale_decision' AS type, user_id, CAST(id AS VARCHAR) AS subject, 'Your ' || scope || ' decision "' || substr(trigger, 1, 80) || '" is ' || days || ' days old and may need to be reviewed or confirmed still relevant.' AS text,
      '{{"decision_id":' || id || ',"scope":"' || scope || '","days_old":' || days || '}}' AS payload FROM x WHERE days > most AND user_id IS NOT NULL""",
        "decisions",
    ),
)(lambda s, d: R.notify_stale(B.decisions(s, d), B.as_of()).select("type", "user_id", "subject", "text", "payload"))
query(
    "x19_json_lists",
    "SELECT event_id, CASE WHEN starts_with(replace(props, ' ', ''), '{') THEN '[' || replace(props, ' ', '') || ']' ELSE replace(props, ' ', '') END AS json FROM events",
)(lambda s, d: B.events(s, d).select("event_id", X.recover_json(F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```")), True).alias("json")))


def _pack_parts(s, d):
    """Entities and chains of the newest ten decisions of each project and scope."""
    from pyspark.sql import Window

    w = Window.partitionBy("project_name", "scope").orderBy(F.desc("created_at"), "id")
    pack = settled(B.decisions(s, d).withColumn("r", F.row_number().over(w)).where("r <= 10").select(F.concat_ws("/", "project_name", "scope").alias("query"), "id"))
    e = S.pack_entities(pack, B.involves(s, d), B.entities(s, d), B.edges(s, d))
    c = S.pack_chains(pack, B.supersedes(s, d), B.contradicts(s, d))
    e = e.select("query", F.lit("entity").alias("part"), F.col("place").cast("bigint").alias("place"), F.concat_ws(":", "id", "name", "type", "decisions", F.array_join("related", ",")).alias("text"))
    return e.unionByName(c.select("query", F.col("kind").alias("part"), F.col("place").cast("bigint").alias("place"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("text")))


query(
    "s11_pack_parts",
    sql(
        """, p AS (SELECT project_name || '/' || scope AS query, id FROM decisions QUALIFY row_number() OVER (PARTITION BY project_name, scope ORDER BY created_at DESC, id) <= 10),
    n AS (SELECT query, e.id, e.name, e.type, count(DISTINCT p.id) AS n FROM p JOIN involves i ON i.src = p.id JOIN entities e ON e.id = i.dst GROUP BY 1, 2, 3, 4),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, name, id) AS place FROM n QUALIFY place <= 30),
    b AS (SELECT src AS id, dst AS o FROM related UNION SELECT dst, src FROM related), bn AS (SELECT DISTINCT b.id, e.name FROM b JOIN entities e ON e.id = b.o),
    r AS (SELECT id, string_agg(name, ',' ORDER BY name) AS related FROM (SELECT * FROM bn QUALIFY row_number() OVER (PARTITION BY id ORDER BY name) <= 5) GROUP BY 1),
    h AS (SELECT [src, dst] AS path FROM supersedes UNION ALL SELECT [a.src, a.dst, b.dst] FROM supersedes a JOIN supersedes b ON b.src = a.dst UNION ALL SELECT [a.src, a.dst, b.dst, c.dst] FROM supersedes a JOIN supersedes b ON b.src = a.dst JOIN supersedes c ON c.src = b.dst),
    m AS (SELECT query, 'supersedes' AS part, path FROM p JOIN h ON path[1] = p.id UNION SELECT query, 'supersedes', path FROM p JOIN h ON path[len(path)] = p.id UNION SELECT query, 'contradicts', [least(src, dst), greatest(src, dst)] FROM p JOIN contradicts ON src = id OR dst = id)
    SELECT query, 'entity' AS part, place, concat_ws(':', t.id, name, type, n, coalesce(related, '')) AS text FROM t LEFT JOIN r USING (id)
    UNION ALL SELECT query, part, place, array_to_string(path, '>') FROM (SELECT *, row_number() OVER (PARTITION BY query, part ORDER BY len(path), path) AS place FROM m) WHERE place <= 5""",
        "decisions", "entities", "involves", "related", "supersedes", "contradicts",
    ),
)(_pack_parts)

"""The test tables as the engine's tables: one function each, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import tasks_over

AS_OF = "2001-08-02 00:00:00"
FILES_AS_OF = "2002-01-30 00:00:00"
EVENTS_AS_OF = "2024-02-01 00:00:00"

SCOPES = {"1-URGENT": "operational", "2-HIGH": "config", "3-MEDIUM": "library", "4-NOT SPECIFIED": "unknown", "5-LOW": "strategic"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as decisions."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    scope = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SCOPES.items() for x in kv]), F.col("o_orderpriority")), F.lit("unknown"))
    key = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        key.alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("project_name"),
        scope.alias("scope"),
        F.col("o_orderstatus").alias("source"),
        F.col("o_orderdate").alias("created_at"),
        ((F.col("o_totalprice") % 1000) / 1000).alias("confidence"),
        F.concat(F.lit("Choose how to ship "), F.lower("o_orderpriority")).alias("trigger"),
        F.concat(F.lit("Market "), F.lower("c_mktsegment")).alias("context"),
        F.when(key % 11 != 0, F.concat(F.lit("Ship with status "), F.col("o_orderstatus"))).alias("agent_decision"),
        F.when(key % 7 != 0, F.concat(F.lit("Price "), F.floor("o_totalprice").cast("string"), F.lit(" because of demand"))).alias("agent_rationale"),
        F.when(key % 3 != 0, F.lit("seen")).alias("human_rationale"),
        F.when(key % 5 == 0, F.col("o_orderdate") + F.expr("INTERVAL 100 DAYS")).alias("last_reviewed_at"),
        F.when(key % 4 != 0, key % 9).cast("int").alias("turn_index"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))


def involves(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_discount")
    return lines.repartition(tasks_over(lines), "src").groupBy("src", "dst").agg(F.max(1 - F.col("l_discount")).alias("weight"))


def _by_customer(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.repartition(tasks_over(o), "o_custkey")


def supersedes(spark: SparkSession, d: str) -> DataFrame:
    """Each order supersedes its customer's order before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _by_customer(spark, d).select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst")).where("dst IS NOT NULL")


def contradicts(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth order contradicts its customer's order two before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _by_customer(spark, d).select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey", 2).over(w).alias("dst")).where("dst IS NOT NULL AND src % 4 = 0")


def related(spark: SparkSession, d: str) -> DataFrame:
    """Part pairs of one order and supplier: from the lesser to the greater key, and back where the sum is even."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").distinct()
    r = l.select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("other"))
    pairs = l.join(r, ["l_orderkey", "l_suppkey"]).where("l_partkey < other OR (l_partkey > other AND (l_partkey + other) % 2 = 0)")
    return pairs.select(F.col("l_partkey").alias("src"), F.col("other").alias("dst")).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """All relationships in one table (src, dst, rel, weight, confidence)."""
    null = F.lit(None).cast("double")
    parts = [
        involves(spark, d).select("src", "dst", F.lit("INVOLVES").alias("rel"), "weight", null.alias("confidence")),
        supersedes(spark, d).select("src", "dst", F.lit("SUPERSEDES").alias("rel"), null.alias("weight"), ((F.col("src") % 100) / 100).alias("confidence")),
        contradicts(spark, d).select("src", "dst", F.lit("CONTRADICTS").alias("rel"), null.alias("weight"), ((F.col("src") % 10) / 10).alias("confidence")),
        related(spark, d).select("src", "dst", F.lit("RELATED_TO").alias("rel"), null.alias("weight"), null.alias("confidence")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def affects(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return lines.repartition(tasks_over(lines), "src").distinct()


def files(spark: SparkSession, d: str) -> DataFrame:
    s, l = table(spark, d, "supplier"), table(spark, d, "lineitem")
    last = l.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last_modified"))
    return s.join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("file"), F.concat(F.lit("src/"), F.col("s_nationkey").cast("string"), F.lit("/"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", "_")), F.when(F.col("s_suppkey") % 2 == 0, F.lit(".py")).otherwise(F.lit(".ts"))).alias("path"), "last_modified")


def commits(spark: SparkSession, d: str) -> DataFrame:
    """One commit for each supplier and ship day."""
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("author"), F.col("l_shipdate").alias("committed_at")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("files_changed")).withColumn("sha", F.sha2(F.concat_ws("|", F.col("author").cast("string"), F.date_format("committed_at", "yyyy-MM-dd")), 256))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("user_id"), "embedding")


#: The same tables as SQL, by name; a query's WITH clause takes those it names.
SQL = {
    "decisions": """SELECT o_orderkey AS id, o_custkey AS user_id, c_mktsegment AS project_name,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'operational' WHEN '2-HIGH' THEN 'config' WHEN '3-MEDIUM' THEN 'library' WHEN '5-LOW' THEN 'strategic' ELSE 'unknown' END AS scope,
      o_orderstatus AS source, o_orderdate AS created_at, (o_totalprice % 1000) / 1000 AS confidence,
      'Choose how to ship ' || lower(o_orderpriority) AS trigger, 'Market ' || lower(c_mktsegment) AS context,
      CASE WHEN o_orderkey % 11 <> 0 THEN 'Ship with status ' || o_orderstatus END AS agent_decision,
      CASE WHEN o_orderkey % 7 <> 0 THEN 'Price ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' because of demand' END AS agent_rationale,
      CASE WHEN o_orderkey % 3 <> 0 THEN 'seen' END AS human_rationale,
      CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 100 DAY END AS last_reviewed_at,
      CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 9 AS INTEGER) END AS turn_index
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "entities": "SELECT p_partkey AS id, p_name AS name, p_type AS type FROM part",
    "involves": "SELECT l_orderkey AS src, l_partkey AS dst, max(1 - l_discount) AS weight FROM lineitem GROUP BY 1, 2",
    "supersedes": "SELECT * FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL",
    "contradicts": "SELECT * FROM (SELECT o_orderkey AS src, lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL AND src % 4 = 0",
    "related": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE a.l_partkey < b.l_partkey OR (a.l_partkey > b.l_partkey AND (a.l_partkey + b.l_partkey) % 2 = 0)",
    "edges": """SELECT src, dst, 'INVOLVES' AS rel, weight, NULL::DOUBLE AS confidence FROM involves
      UNION ALL SELECT src, dst, 'SUPERSEDES', NULL, (src % 100) / 100 FROM supersedes
      UNION ALL SELECT src, dst, 'CONTRADICTS', NULL, (src % 10) / 10 FROM contradicts
      UNION ALL SELECT src, dst, 'RELATED_TO', NULL, NULL FROM related""",
    "affects": "SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem",
    "files": """SELECT s_suppkey AS file, 'src/' || s_nationkey || '/' || lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g')) || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.ts' END AS path, last_modified
      FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS last_modified FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""",
    "commits": "SELECT l_orderkey % 500 AS author, l_shipdate AS committed_at, list_sort(list_distinct(list(l_suppkey))) AS files_changed, sha256(concat_ws('|', CAST(l_orderkey % 500 AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d'))) AS sha FROM lineitem GROUP BY 1, 2",
    "messages": "SELECT conv_id, turn AS turn_index, role, text AS content FROM conversations",
    "vectors": "SELECT vec_id AS id, label AS user_id, embedding FROM embeddings",
}
ORDER = list(SQL)


def sql(body: str, *names: str) -> str:
    """body after a WITH of the named tables (and those they need); body may go on with `, x AS (...)` before its SELECT."""
    need = set(names)
    if "edges" in need:
        need |= {"involves", "supersedes", "contradicts", "related"}
    parts = [f"{n} AS ({SQL[n]})" for n in ORDER if n in need]
    body = body.strip()
    if body.startswith(","):
        return "WITH " + ",\n".join(parts) + body
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body

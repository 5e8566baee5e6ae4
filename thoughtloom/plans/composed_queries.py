"""Queries of the composed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import graph as G
from ..operators import integrity as V
from ..operators import metrics as M
from ..operators import rules as R
from ..operators import search as S
from . import bindings as B
from .bindings import sql
from .more_queries import _BM25, _COS, _DUPLICATES, _NAMES, _NEAR, _SEM, _aliases, _asked, _corpus, _full, _semantic
from .queries import _PAIRS, joined, query

query(
    "j24_verdict_edges",
    sql(
        f""", p AS ({_PAIRS}), v AS (SELECT a, b, CASE (a + b) % 3 WHEN 0 THEN 'SUPERSEDES' WHEN 1 THEN 'CONTRADICTS' ELSE 'NONE' END AS verdict, ((a * 3 + b) % 10) / 10 AS confidence FROM p)
    SELECT CASE WHEN verdict = 'SUPERSEDES' AND y.created_at > x.created_at THEN b ELSE a END AS src, CASE WHEN verdict = 'SUPERSEDES' AND y.created_at > x.created_at THEN a ELSE b END AS dst, verdict AS rel, v.confidence
    FROM v JOIN decisions x ON x.id = a JOIN decisions y ON y.id = b WHERE verdict <> 'NONE' AND v.confidence >= 0.6""",
        "involves", "decisions",
    ),
)(
    lambda s, d: (
        lambda p: G.verdict_edges(p, p.select("a", "b", F.element_at(F.array(F.lit("SUPERSEDES"), F.lit("CONTRADICTS"), F.lit("NONE")), ((F.col("a") + F.col("b")) % 3 + 1).cast("int")).alias("verdict"), (((F.col("a") * 3 + F.col("b")) % 10) / 10).alias("confidence")), B.decisions(s, d))
    )(G.shared_entity_pairs(B.involves(s, d), 2))
)

query(
    "j25_shared_entity_groups",
    sql(f", p AS ({_PAIRS}), g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS id, a AS c FROM g UNION SELECT id, b FROM r JOIN g ON g.a = r.c) SELECT id, min(c) AS component FROM r WHERE id IN (SELECT id FROM decisions) GROUP BY 1", "involves", "decisions").replace("WITH ", "WITH RECURSIVE ", 1),
)(lambda s, d: G.shared_entity_groups(B.decisions(s, d), B.involves(s, d)))

query(
    "j26_session_messages",
    """SELECT conv_id AS session, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, list_aggregate(list_sort(list_distinct(list('e' || turn % 3))), 'string_agg', ',') AS entities FROM conversations GROUP BY 1""",
)(
    lambda s, d: (
        lambda c: G.session_messages(c.select(F.col("conv_id").alias("session")), c.select(F.col("conv_id").alias("session"), F.col("turn").alias("ts"), F.col("turn").alias("id"), "role", F.to_json(F.array(F.concat(F.lit("e"), (F.col("turn") % 3).cast("string")))).alias("extracted_entities")))
    )(B.table(s, d, "conversations")).select("session", F.col("n").cast("bigint").alias("n"), joined("roles", "roles"), joined("entities", "entities"))
)

query(
    "s03_semantic_search",
    sql(f", p AS (SELECT a.id AS query, b.id, {_COS} AS s FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.id % 20 = 0) SELECT query, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS r FROM p WHERE s > 0.25) WHERE r <= 10", "vectors"),
)(lambda s, d: S.similar(B.vectors(s, d).where("id % 20 = 0"), B.vectors(s, d), 10, 0.25).select("query", "id", F.round("score", 6).alias("score")))

query(
    "s11_context_pack",
    f"""WITH {_BM25}, {_SEM}, h AS (SELECT coalesce(bm.query, sem.query) AS query, coalesce(bm.id, sem.id) AS id, 0.3 * CASE WHEN s IS NULL THEN 0 ELSE least(s / 10, 1) END + 0.7 * coalesce(score, 0) AS combined FROM bm FULL JOIN sem ON bm.query = sem.query AND bm.id = sem.id),
    c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(combined, 9) DESC, id) AS place FROM h), k AS (SELECT query, c.id, place, combined, sum(length(text) // 4) OVER (PARTITION BY query ORDER BY place ROWS UNBOUNDED PRECEDING) AS spent FROM c JOIN documents ON doc_id = c.id WHERE place <= 10)
    SELECT query, id, place, round(combined, 6) AS combined, id % 2 = 1 AS is_current FROM k WHERE spent <= 6000""",
)(
    lambda s, d: S.context_pack(
        S.bm25(_asked(s, d), _corpus(s, d)), _semantic(s, d), B.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("trigger"), *[F.lit(None).cast("string").alias(c) for c in ("context", "agent_decision", "agent_rationale")]),
        B.table(s, d, "documents").where("doc_id % 2 = 0").select((F.col("doc_id") + 1).alias("src"), F.col("doc_id").alias("dst")), budget=6000,
    ).select("query", "id", F.col("place").cast("bigint").alias("place"), F.round("combined", 6).alias("combined"), "is_current")
)

query("s13_sort_options", sql("SELECT id FROM decisions ORDER BY confidence DESC, id LIMIT 30", "decisions"))(lambda s, d: S.sort_results(B.decisions(s, d), "confidence").limit(30).select("id"))

query(
    "s16_entity_context",
    sql(
        """, n AS (SELECT DISTINCT name FROM entities), h AS (SELECT DISTINCT n.name, i.src FROM n JOIN entities e ON lower(trim(e.name)) = lower(trim(n.name)) JOIN involves i ON i.dst = e.id),
    b AS (SELECT h.name, count(*) AS decisions, count(*) FILTER (h.src NOT IN (SELECT dst FROM supersedes)) AS current FROM h JOIN decisions d ON d.id = h.src GROUP BY 1),
    o AS (SELECT h.name, e.name AS other, count(DISTINCT h.src) AS n FROM h JOIN involves i ON i.src = h.src JOIN entities e ON e.id = i.dst WHERE lower(trim(e.name)) <> lower(trim(h.name)) GROUP BY 1, 2),
    t AS (SELECT name, string_agg(other, ',' ORDER BY r) AS related FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, other) AS r FROM o) WHERE r <= 20 GROUP BY 1)
    SELECT b.name, decisions, current, CASE WHEN current = decisions THEN 'active' WHEN current > 0 THEN 'partially_superseded' ELSE 'superseded' END AS status, coalesce(related, '') AS related FROM b LEFT JOIN t USING (name)""",
        "entities", "involves", "decisions", "supersedes",
    ),
)(lambda s, d: G.entity_context(B.entities(s, d).select("name"), B.entities(s, d), B.involves(s, d), B.decisions(s, d), B.supersedes(s, d)).select("name", "decisions", "current", "status", joined("related", "related")))

query(
    "s17_recorded_context",
    sql(
        """, w AS (SELECT id FROM decisions), s AS (SELECT src, dst, (dst % 10) / 10 AS c FROM contradicts),
    t AS (SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY r) AS similar_ids FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS r FROM s) WHERE r <= 5 GROUP BY 1)
    SELECT w.id, coalesce(CAST(p.dst AS VARCHAR), '') AS supersedes, coalesce(similar_ids, '') AS similar_ids FROM w LEFT JOIN supersedes p ON p.src = w.id LEFT JOIN t ON t.id = w.id""",
        "decisions", "supersedes", "contradicts",
    ),
)(
    lambda s, d: G.recorded_context(
        B.decisions(s, d), G.of(B.edges(s, d), "INVOLVES", "SUPERSEDES").unionByName(B.contradicts(s, d).select("src", "dst", F.lit("SIMILAR_TO").alias("rel"), F.lit(None).cast("double").alias("weight"), ((F.col("dst") % 10) / 10).alias("confidence"))), B.entities(s, d)
    ).select("id", joined("supersedes", "supersedes"), joined("similar", "similar_ids"))
)

query("r08_alert_overlap", sql("SELECT id, 'stock of ' || scope || ' is fresh' AS assumption, m.a AS alert FROM decisions JOIN (VALUES ('BUILDING', 'b1')) m(p, a) ON m.p = project_name", "decisions"))(
    lambda s, d: R.alert_violations(
        B.decisions(s, d).withColumn("assumptions", F.array(F.concat(F.lit("stock of "), F.col("scope"), F.lit(" is fresh")))),
        B.table(s, d, "customer").select(F.col("c_mktsegment").alias("project_name")).distinct().withColumn("alert", F.when(F.col("project_name") == "BUILDING", "b1").otherwise(F.lit("m1"))).withColumn("text", F.when(F.col("alert") == "b1", "stock low and no fresh items").otherwise("nothing")),
    )
)


def _all_edges(s, d):
    """The edges, part dependencies among them, and some self loops and wrong levels."""
    e = B.edges(s, d).where("rel <> 'RELATED_TO'")
    own = lambda df, rel: df.select("src", "dst", F.lit(rel).alias("rel"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("confidence"))
    loops = B.supersedes(s, d).where("src % 50 = 0").withColumn("dst", F.col("src"))
    return e.unionByName(own(B.related(s, d), "DEPENDS_ON")).unionByName(own(loops, "FOLLOWS"))


_LEVELS = """e AS (SELECT src, dst, rel, confidence FROM edges WHERE rel <> 'RELATED_TO' UNION ALL SELECT src, dst, 'DEPENDS_ON', NULL FROM related UNION ALL SELECT src, src, 'FOLLOWS', NULL FROM supersedes WHERE src % 50 = 0),
    low AS (SELECT * FROM e WHERE confidence < 0.5 AND src IN (SELECT id FROM decisions) ORDER BY confidence, src, dst LIMIT 50),
    i AS (SELECT 'low_confidence' AS type, 'INFO' AS severity FROM low UNION ALL SELECT 'self_loop', 'ERROR' FROM e WHERE src = dst
      UNION ALL SELECT 'orphan_entity', 'WARNING' FROM entities WHERE id IN (SELECT dst FROM involves) AND id NOT IN (SELECT src FROM related UNION SELECT dst FROM related)
      UNION ALL SELECT 'invalid_relationship', 'ERROR' FROM related WHERE src IN (SELECT id FROM decisions) AND dst IN (SELECT id FROM decisions)
      UNION ALL SELECT 'duplicate_entity', severity FROM dup
      UNION ALL SELECT DISTINCT 'missing_embedding', 'WARNING' FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT DISTINCT 'missing_embedding', 'INFO' FROM embeddings WHERE vec_id % 5 = 0
      UNION ALL SELECT 'circular_dependency', 'ERROR' FROM ten)"""
# the report of the ten shortest cycles: these tables have more than ten cycles of two
_TEN = "ten AS (SELECT a.src, a.dst FROM related a JOIN related b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst ORDER BY 1, 2 LIMIT 10)"
_ISSUES = f"{_TEN}, {_NAMES}, {_NEAR}, {_DUPLICATES}, {_LEVELS}"


def _issues(s, d):
    kept = lambda kind, n: B.vectors(s, d).select(F.lit(kind).alias("kind"), "id", F.when(F.col("id") % n != 0, F.col("embedding")).alias("embedding"))
    return V.validate_all(B.decisions(s, d), B.entities(s, d), _all_edges(s, d), _aliases(s, d), kept("decision", 3).unionByName(kept("entity", 5)))


query("v10_validate_all", sql(f", {_ISSUES} SELECT type, severity, count(*) AS n FROM i GROUP BY 1, 2", "decisions", "entities", "edges"))(
    lambda s, d: _issues(s, d).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "a24_validation_summary",
    sql(f", {_ISSUES} SELECT 'severity' AS kind, k AS key, count(i.type) AS n FROM (VALUES ('ERROR'), ('WARNING'), ('INFO')) l(k) LEFT JOIN i ON i.severity = k GROUP BY 1, 2 UNION ALL SELECT 'type', type, count(*) FROM i GROUP BY 1, 2", "decisions", "entities", "edges"),
)(lambda s, d: M.validation_summary(_issues(s, d)))

query("x02_arc_label", "SELECT l_orderkey AS id, CASE WHEN count(*) FILTER (l_returnflag <> 'N') = 0 THEN CASE WHEN count(*) <= 2 THEN 'setup' ELSE 'verification' END WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'exploration' WHEN count(*) FILTER (l_returnflag = 'A') = 0 THEN 'implementation' ELSE 'pivot' END AS arc FROM lineitem GROUP BY 1")(
    lambda s, d: B.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_returnflag") == "R", "Edit").when(F.col("l_returnflag") == "A", "Read")).alias("tools"), F.count(F.lit(1)).alias("n")).select("id", X.arc_label(F.col("tools"), F.col("n")).alias("arc"))
)
query("x03_episode_features", "SELECT conv_id, turn // 3 AS episode, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) || chr(10) ORDER BY turn), '')) AS thinking, list_aggregate(list_sort(list_distinct(list('f' || turn % 2))), 'string_agg', ',') AS files FROM conversations GROUP BY 1, 2")(
    lambda s, d: X.episode_features(B.messages(s, d).select("conv_id", F.floor(F.col("turn_index") / 3).alias("episode"), "turn_index", F.when(F.col("role") == "assistant", F.col("content")).alias("thinking"), F.array(F.concat(F.lit("f"), (F.col("turn_index") % 2).cast("string"))).alias("files"))).select("conv_id", "episode", F.sha2("thinking", 256).alias("thinking"), joined("files", "files"))
)
query("x21_truth_completeness", sql("SELECT id, ((length(trigger) >= 20)::INT + (length(context) >= 20)::INT + (length(coalesce(agent_decision, '')) >= 20)::INT + (length(coalesce(agent_rationale, '')) >= 20)::INT) / 5 AS share FROM decisions", "decisions"))(lambda s, d: _full(s, d).select("id", X.completeness(20, 20).alias("share")))
query(
    "x23_model_comparison",
    """WITH r AS (SELECT event_type AS model, event_id % 5 AS m, 5 AS e, event_id % 4 AS f, 4 AS t, (user_id % 100) / 100 AS c, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    g AS (SELECT model, sum(m) / sum(e) AS p, sum(f) / sum(t) AS q, round(avg(c), 6) AS avg_confidence, round(max(value) FILTER (k = least(floor(n * 0.50), n - 1)), 6) AS p50, round(max(value) FILTER (k = least(floor(n * 0.99), n - 1)), 6) AS p99 FROM r GROUP BY 1)
    SELECT model, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / (p + q), 6) AS f1, avg_confidence, p50, p99 FROM g""",
)(lambda s, d: X.compare_models(B.events(s, d).select(F.col("event_type").alias("model"), (F.col("event_id") % 5).alias("matched"), F.lit(5).alias("n_extracted"), (F.col("event_id") % 4).alias("found"), F.lit(4).alias("n_truth"), ((F.col("user_id") % 100) / 100).alias("confidence"), F.col("value").alias("latency"))))

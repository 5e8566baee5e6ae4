"""Queries of the operators over the test tables, each beside its SQL.

A query is (operator id + name) -> (Spark plan, DuckDB SQL). Timestamps leave as text, arrays as joined
text, rounded numbers at six places, so that both sides compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import metrics as M
from ..operators import projections as P
from ..operators import rules as R
from . import bindings as B
from .bindings import sql

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}

NOW = f"TIMESTAMP '{B.AS_OF}'"
FILES_NOW = f"TIMESTAMP '{B.FILES_AS_OF}'"
EVENTS_NOW = f"TIMESTAMP '{B.EVENTS_AS_OF}'"


def query(name: str, oracle: str | None = None):
    """Registers a plan under a name, with its SQL."""

    def put(f: Plan) -> Plan:
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return put


def text(c: str, as_: str | None = None):
    """Timestamps and dates as text."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(as_ or c)


def joined(c, as_: str):
    """Arrays as text, NULL and empty alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")).alias(as_)


# ---- projections and filters

query("p01_tenant_predicate", sql("SELECT id, user_id FROM decisions WHERE user_id % 10 = 1", "decisions"))(lambda s, d: P.visible_to(B.decisions(s, d).withColumn("bucket", F.col("user_id") % 10).withColumnRenamed("user_id", "u").withColumnRenamed("bucket", "user_id"), 1).select("id", F.col("u").alias("user_id")))

query("p02_legacy_columns", sql("SELECT id, agent_decision, agent_rationale FROM decisions", "decisions"))(
    lambda s, d: P.normalize_decisions(B.decisions(s, d).select("id", F.when(F.col("id") % 2 == 0, F.col("agent_decision")).alias("agent_decision"), F.col("agent_decision").alias("decision"), F.col("agent_rationale").alias("rationale")))
)

query(
    "p03_display_defaults",
    sql("SELECT id, trigger, context, coalesce(agent_decision, '(not recorded)') AS agent_decision, coalesce(agent_rationale, '(not recorded)') AS agent_rationale, coalesce(confidence, 0.0) AS confidence, coalesce(source, 'unknown') AS source FROM decisions", "decisions"),
)(lambda s, d: P.with_display_defaults(B.decisions(s, d)).select("id", "trigger", "context", "agent_decision", "agent_rationale", "confidence", "source"))

query("p04_extraction_defaults", sql("SELECT id, trigger, coalesce(agent_decision, '') AS agent_decision, coalesce(agent_rationale, '') AS agent_rationale, coalesce(confidence, 0.5) AS confidence FROM decisions", "decisions"))(
    lambda s, d: P.apply_extraction_defaults(B.decisions(s, d)).select("id", "trigger", "agent_decision", "agent_rationale", "confidence")
)

query(
    "p05_span_decode",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 100 AS INTEGER) END AS start_char, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 100 + 7 AS INTEGER) END AS end_char,
    CASE WHEN event_id % 3 = 0 THEN 'd' || event_id ELSE 't' || event_id END AS quote FROM events""",
)(
    lambda s, d: P.decode_spans(
        B.events(s, d).select(
            "event_id",
            F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct((F.col("event_id") % 100).alias("start_char"), (F.col("event_id") % 100 + 7).alias("end_char")))).alias("decision_span"),
            F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("d"), "event_id")).otherwise(F.lit(" ")).alias("verbatim_decision"),
            F.concat(F.lit("t"), "event_id").alias("verbatim_trigger"),
        )
    ).select("event_id", "start_char", "end_char", "quote")
)

query("p06_source_project_filter", sql("SELECT id FROM decisions WHERE coalesce(source, 'unknown') = 'F' AND project_name = 'BUILDING'", "decisions"))(lambda s, d: P.filter_project(P.filter_source(B.decisions(s, d), "F"), "BUILDING").select("id"))

query(
    "p07_list_filter",
    sql(f"SELECT id, trigger FROM decisions WHERE (contains(lower(trigger), 'urgent') OR contains(lower(coalesce(agent_decision, '')), 'urgent')) AND source = 'O' AND confidence >= 0.5 AND created_at >= date_trunc('day', {NOW}) - INTERVAL 900 DAY", "decisions"),
)(lambda s, d: P.filter_decisions(B.decisions(s, d), B.as_of(), "URGENT", "O", 0.5, 900).select("id", "trigger"))

query("p08_edge_flags", sql("SELECT src, dst, rel FROM edges WHERE rel IN ('SUPERSEDES', 'RELATED_TO') AND (confidence IS NULL OR confidence >= 0.5)", "edges"))(lambda s, d: P.select_edges(B.edges(s, d), ["SUPERSEDES", "RELATED_TO"], 0.5).select("src", "dst", "rel"))

query("p09_edge_weight", sql("SELECT src, dst, rel, round(greatest(0, least(1, coalesce(nullif(weight, 0), nullif(confidence, 0), 1))), 6) AS weight_shown FROM edges", "edges"))(lambda s, d: P.edge_weight(B.edges(s, d)).select("src", "dst", "rel", F.round("weight_shown", 6).alias("weight_shown")))

query("p10_needs_review", sql("SELECT id, confidence FROM decisions WHERE human_rationale IS NULL ORDER BY confidence DESC, id LIMIT 25", "decisions"))(lambda s, d: P.needs_review(B.decisions(s, d)).select("id", "confidence").orderBy(F.desc("confidence"), "id").limit(25))

query("p11_source_tagging", sql("SELECT id, CASE WHEN id % 6 = 0 THEN 'unknown' ELSE source END AS source, id % 6 = 0 AS tagged FROM decisions", "decisions"))(lambda s, d: P.tag_sources(B.decisions(s, d).withColumn("source", F.when(F.col("id") % 6 != 0, F.col("source")))).select("id", "source", "tagged"))

query("p12_project_case", sql("SELECT id, project_name AS old_name, lower(project_name) AS new_name FROM decisions WHERE project_name <> lower(project_name)", "decisions"))(lambda s, d: P.normalize_projects(B.decisions(s, d)))

query(
    "p13_field_update",
    sql(f"SELECT id, CASE WHEN id % 10 = 0 THEN 'changed' ELSE trigger END AS trigger, agent_decision, CASE WHEN id % 10 = 0 THEN '{B.AS_OF}' END AS edited_at, CAST(CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS edit_count FROM decisions", "decisions"),
)(
    lambda s, d: P.apply_updates(
        B.decisions(s, d), B.table(s, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"), F.lit("changed").alias("trigger"), F.lit(None).cast("string").alias("agent_decision")), B.as_of()
    ).select("id", "trigger", "agent_decision", text("edited_at"), "edit_count")
)

query(
    "p14_review_stamp",
    sql(f"SELECT id, strftime(CASE WHEN id % 8 = 0 THEN {NOW} ELSE last_reviewed_at END, '%Y-%m-%d %H:%M:%S') AS last_reviewed_at, CASE WHEN id % 8 = 0 THEN 'ok' END AS review_notes FROM decisions", "decisions"),
)(lambda s, d: P.mark_reviewed(B.decisions(s, d), B.table(s, d, "orders").where("o_orderkey % 8 = 0").select(F.col("o_orderkey").alias("id"), F.lit("ok").alias("notes")), B.as_of())[0].select("id", text("last_reviewed_at"), "review_notes"))

query(
    "p15_row_validation",
    sql("SELECT id, CASE WHEN agent_decision IS NULL THEN 'agent_decision' WHEN agent_rationale IS NULL THEN 'agent_rationale' END AS reason FROM decisions WHERE agent_decision IS NULL OR agent_rationale IS NULL", "decisions"),
)(lambda s, d: P.validate_decisions(B.decisions(s, d))[1].select("id", "reason"))

# ---- joins and patterns

query(
    "j01_decisions_with_entities",
    sql("SELECT d.id, coalesce(string_agg(CAST(e.id AS VARCHAR) || ':' || e.type, ',' ORDER BY e.id), '') AS entities FROM decisions d LEFT JOIN involves i ON i.src = d.id LEFT JOIN entities e ON e.id = i.dst GROUP BY d.id", "decisions", "involves", "entities"),
)(lambda s, d: G.decisions_with_entities(B.decisions(s, d).select("id"), B.entities(s, d), B.involves(s, d)).select("id", joined(F.transform("entities", lambda e: F.concat(e["id"].cast("string"), F.lit(":"), e["type"])), "entities")))

_PAGE = "SELECT id FROM decisions ORDER BY created_at DESC, id LIMIT 50 OFFSET 50"
query(
    "j02_graph_page",
    sql(
        f""", p AS ({_PAGE}), e AS (SELECT DISTINCT i.src, i.dst FROM involves i JOIN p ON p.id = i.src)
    SELECT 'decision' AS kind, id AS src, -1::BIGINT AS dst FROM p UNION ALL SELECT DISTINCT 'entity', dst, -1 FROM e UNION ALL SELECT 'INVOLVES', src, dst FROM e
    UNION ALL SELECT rel, src, dst FROM edges WHERE rel IN ('SUPERSEDES', 'CONTRADICTS') AND src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p)""",
        "decisions", "edges",
    ),
)(lambda s, d: G.graph_page(B.decisions(s, d), B.involves(s, d), G.of(B.edges(s, d), "SUPERSEDES", "CONTRADICTS"), 2, 50).fillna(-1, ["dst"]))

query(
    "j03_full_graph",
    sql(
        """, v AS (SELECT id FROM decisions), inv AS (SELECT src, dst FROM involves WHERE src IN (SELECT id FROM v)), k AS (SELECT DISTINCT dst FROM inv WHERE dst IN (SELECT id FROM entities))
    SELECT src, dst, 'INVOLVES' AS rel FROM inv WHERE dst IN (SELECT dst FROM k)
    UNION ALL SELECT src, dst, rel FROM edges WHERE rel IN ('SUPERSEDES', 'CONTRADICTS') AND src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)
    UNION ALL SELECT src, dst, rel FROM edges WHERE rel = 'RELATED_TO' AND src IN (SELECT dst FROM k) AND dst IN (SELECT dst FROM k)""",
        "decisions", "entities", "edges",
    ),
)(lambda s, d: G.full_graph(B.decisions(s, d), B.entities(s, d), B.edges(s, d)))

query(
    "j04_neighbors",
    sql(
        """, b AS (SELECT DISTINCT src AS id, 'outgoing' AS direction, 'RELATED_TO' AS rel, dst AS other FROM related UNION SELECT DISTINCT dst, 'incoming', 'RELATED_TO', src FROM related)
    SELECT id, direction, rel, other FROM (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY rel, other) AS r FROM b) WHERE r <= 3""",
        "related",
    ),
)(lambda s, d: G.neighbors(G.of(B.edges(s, d), "RELATED_TO"), limit=3))

query("j05_visible_entities", sql("SELECT id, type FROM entities WHERE id IN (SELECT dst FROM involves WHERE src IN (SELECT id FROM decisions))", "entities", "involves", "decisions"))(lambda s, d: G.visible_entities(B.entities(s, d), B.involves(s, d), B.decisions(s, d)).select("id", "type"))

query(
    "j06_node_details",
    sql(
        """, n AS (SELECT i.src AS id, string_agg(DISTINCT e.name, ',' ORDER BY e.name) AS entity_names FROM involves i JOIN entities e ON e.id = i.dst GROUP BY 1),
    su AS (SELECT src AS id, string_agg(DISTINCT CAST(dst AS VARCHAR), ',') AS supersedes FROM supersedes GROUP BY 1),
    co AS (SELECT id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS contradicts FROM (SELECT src AS id, dst AS o FROM contradicts UNION SELECT dst, src FROM contradicts) GROUP BY 1)
    SELECT d.id, coalesce(entity_names, '') AS entity_names, coalesce(supersedes, '') AS supersedes, coalesce(contradicts, '') AS contradicts FROM decisions d LEFT JOIN n USING (id) LEFT JOIN su USING (id) LEFT JOIN co USING (id)""",
        "decisions", "entities", "edges",
    ),
)(lambda s, d: G.node_details(B.decisions(s, d), B.entities(s, d), B.edges(s, d)).select("id", joined("entity_names", "entity_names"), joined("supersedes", "supersedes"), joined("contradicts", "contradicts")))

_PAIRS = "SELECT a.src AS a, b.src AS b, count(*) AS shared FROM involves a JOIN involves b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2 HAVING count(*) >= 2"
query("j07_shared_entity_pairs", sql(_PAIRS, "involves"))(lambda s, d: G.shared_entity_pairs(B.involves(s, d), 2))

query(
    "j08_influenced_by",
    sql(f", p AS ({_PAIRS}) SELECT CASE WHEN x.created_at > y.created_at THEN a ELSE b END AS src, CASE WHEN x.created_at > y.created_at THEN b ELSE a END AS dst, shared FROM p JOIN decisions x ON x.id = a JOIN decisions y ON y.id = b WHERE x.created_at <> y.created_at", "involves", "decisions"),
)(lambda s, d: G.influenced_by(B.decisions(s, d), B.involves(s, d)))

query(
    "j09_temporal_edges",
    sql(
        """, p AS (SELECT n.id AS new, o.id AS old FROM decisions n JOIN decisions o ON n.user_id = o.user_id AND n.project_name = o.project_name AND o.turn_index < n.turn_index)
    SELECT new AS src, old AS dst, 'FOLLOWS' AS rel FROM p UNION ALL SELECT old, new, 'PRECEDES' FROM p""",
        "decisions",
    ),
)(lambda s, d: G.temporal_edges(B.decisions(s, d)))

query(
    "j10_entity_timeline",
    sql(
        """, n AS (SELECT DISTINCT name FROM entities), h AS (SELECT DISTINCT n.name, i.src AS id FROM n JOIN entities e ON lower(trim(e.name)) = lower(trim(n.name)) JOIN involves i ON i.dst = e.id)
    SELECT h.name, h.id, row_number() OVER (PARTITION BY h.name ORDER BY d.created_at, h.id) AS position, coalesce(CAST(s.dst AS VARCHAR), '') AS supersedes FROM h JOIN decisions d ON d.id = h.id LEFT JOIN supersedes s ON s.src = h.id""",
        "entities", "involves", "decisions", "supersedes",
    ),
)(lambda s, d: G.entity_timeline(B.entities(s, d).select("name"), B.entities(s, d), B.involves(s, d), B.decisions(s, d), B.supersedes(s, d), B.contradicts(s, d)).select("name", "id", "position", joined("supersedes", "supersedes")))

query(
    "j11_decision_evolution",
    sql(
        """, i AS (SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS influenced_by FROM contradicts GROUP BY 1)
    SELECT d.id, coalesce(i.influenced_by, '') AS influenced_by, coalesce(CAST(a.dst AS VARCHAR), '') AS supersedes, coalesce(CAST(b.src AS VARCHAR), '') AS superseded_by
    FROM decisions d LEFT JOIN i USING (id) LEFT JOIN supersedes a ON a.src = d.id LEFT JOIN supersedes b ON b.dst = d.id""",
        "decisions", "contradicts", "supersedes",
    ),
)(lambda s, d: G.decision_evolution(B.decisions(s, d), B.contradicts(s, d), B.supersedes(s, d)).select("id", joined("influenced_by", "influenced_by"), joined("supersedes", "supersedes"), joined("superseded_by", "superseded_by")))

query(
    "j12_supersession_chains",
    sql(
        """, w1 AS (SELECT src AS start, dst AS "end", 1 AS hops FROM supersedes), w2 AS (SELECT start, s.dst AS "end", 2 AS hops FROM w1 JOIN supersedes s ON s.src = w1."end"), w3 AS (SELECT start, s.dst AS "end", 3 AS hops FROM w2 JOIN supersedes s ON s.src = w2."end")
    SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3""",
        "supersedes",
    ),
)(lambda s, d: G.supersession_chains(B.supersedes(s, d), B.decisions(s, d)).select("start", "end", "hops"))

query("j13_contradictions", sql("SELECT src AS id, dst AS other FROM contradicts UNION SELECT dst, src FROM contradicts", "contradicts"))(lambda s, d: G.contradictions(B.contradicts(s, d)))

def _judged(s, d):
    """Every contradicting pair, and whether it is unresolved."""
    c = B.contradicts(s, d)
    pairs = c.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    found = G.unresolved_contradictions(c, B.supersedes(s, d)).withColumn("unresolved", F.lit(True))
    return pairs.join(found, ["a", "b"], "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(False)))


query(
    "j14_unresolved_contradictions",
    sql("SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, src NOT IN (SELECT dst FROM supersedes) AND dst NOT IN (SELECT dst FROM supersedes) AS unresolved FROM contradicts", "contradicts", "supersedes"),
)(_judged)

query("j15_abandoned_patterns", sql("SELECT DISTINCT e.name, i.src AS old, s.src AS successor FROM entities e JOIN involves i ON i.dst = e.id JOIN supersedes s ON s.dst = i.src", "entities", "involves", "supersedes"))(
    lambda s, d: G.abandoned_patterns(B.entities(s, d).select("name"), B.entities(s, d), B.involves(s, d), B.supersedes(s, d)).select("name", "old", "successor")
)

query(
    "j16_currency",
    sql(
        """, g AS (SELECT i.dst AS entity, count(*) AS n, count(s.dst) AS old FROM involves i LEFT JOIN (SELECT DISTINCT dst FROM supersedes) s ON s.dst = i.src GROUP BY 1)
    SELECT entity, CASE WHEN old = 0 THEN 'active' WHEN old < n THEN 'partially_superseded' ELSE 'superseded' END AS status FROM g""",
        "involves", "supersedes",
    ),
)(lambda s, d: G.entity_status(B.involves(s, d), B.decisions(s, d), B.supersedes(s, d)))

_SESSIONS = "SELECT l_orderkey AS session, min(l_shipdate) AS ts, list_distinct(list(l_suppkey)) AS files FROM lineitem GROUP BY 1"
query(
    "j17_commits_to_sessions",
    sql(
        f""", s AS ({_SESSIONS}), j AS (SELECT session, sha, len(list_intersect(files, files_changed)) AS i, len(list_distinct(list_concat(files, files_changed))) AS u FROM s JOIN commits ON committed_at >= ts AND committed_at <= ts + INTERVAL 2 HOUR)
    SELECT session, sha, round(i / u, 6) AS score FROM j WHERE i / u >= 0.3""",
        "commits",
    ),
)(lambda s, d: G.link_commits(B.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.min("l_shipdate").alias("ts"), F.collect_set("l_suppkey").alias("files")), B.commits(s, d)).select("session", "sha", F.round("score", 6).alias("score")))

query(
    "j18_commits_to_decisions",
    sql(
        """, f AS (SELECT sha, committed_at, len(files_changed) AS n, unnest(files_changed) AS dst FROM commits),
    o AS (SELECT sha, id, n, count(*) AS overlap FROM f JOIN affects a USING (dst) JOIN decisions d ON d.id = a.src WHERE created_at <= committed_at AND created_at >= committed_at - INTERVAL 48 HOUR GROUP BY 1, 2, 3)
    SELECT sha, id, overlap, round(overlap / n, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY overlap DESC, id) AS r FROM o) WHERE r <= 20 AND overlap / n >= 0.3""",
        "commits", "affects", "decisions",
    ),
)(lambda s, d: G.link_decisions(B.decisions(s, d), B.affects(s, d), B.commits(s, d), hours=48).select("sha", "id", "overlap", F.round("score", 6).alias("score")))

query(
    "j19_change_context",
    sql(
        f""", t AS (SELECT change, id, created_at, scope FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY created_at DESC, id DESC) AS r FROM
      (SELECT DISTINCT a.dst // 10 AS change, d.id, d.created_at, d.scope FROM affects a JOIN decisions d ON d.id = a.src)) WHERE r <= 50),
    c AS (SELECT src AS id, dst AS o FROM contradicts UNION SELECT dst, src FROM contradicts)
    SELECT t.change, t.id, floor((epoch({NOW}) - epoch(t.created_at)) / 86400) > CASE t.scope WHEN 'strategic' THEN 730 WHEN 'library' THEN 90 WHEN 'config' THEN 30 WHEN 'operational' THEN 14 ELSE 90 END AS is_stale,
      coalesce((SELECT string_agg(CAST(c.o AS VARCHAR), ',' ORDER BY c.o) FROM c JOIN t u ON u.id = c.o AND u.change = t.change WHERE c.id = t.id), '') AS contradicts FROM t""",
        "affects", "decisions", "contradicts",
    ),
)(lambda s, d: G.change_context(B.affects(s, d).select(F.floor(F.col("dst") / 10).alias("change"), F.col("dst").alias("file")), B.decisions(s, d), B.affects(s, d), B.contradicts(s, d), R.is_stale(B.as_of())).select("change", "id", "is_stale", joined("contradicts", "contradicts")))

query("j20_touches", sql("SELECT DISTINCT sha AS src, unnest(files_changed) AS dst FROM commits", "commits"))(lambda s, d: G.touches(B.commits(s, d)))

query(
    "j21_cross_user_pairs",
    sql(
        """, p AS (SELECT n.id, o.id AS other, row_number() OVER (PARTITION BY n.id ORDER BY o.created_at DESC, o.id DESC) AS rank FROM decisions n JOIN decisions o ON n.project_name = o.project_name AND n.user_id <> o.user_id)
    SELECT id, other, rank FROM p WHERE rank <= 20""",
        "decisions",
    ),
)(lambda s, d: G.cross_user_pairs(B.decisions(s, d), B.decisions(s, d)).withColumn("rank", F.col("rank").cast("bigint")))

query(
    "j22_related_entities",
    sql(
        """, n AS (SELECT DISTINCT x.id, e.name FROM (SELECT src AS id, dst AS o FROM related UNION ALL SELECT dst, src FROM related) x JOIN entities e ON e.id = x.o)
    SELECT id, string_agg(name, ',' ORDER BY name) AS related FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) AS r FROM n) WHERE r <= 5 GROUP BY id""",
        "related", "entities",
    ),
)(lambda s, d: G.related_entities(B.entities(s, d), B.related(s, d)).select("id", joined("related", "related")))

_STAMP = "SELECT i.src, i.dst, d.created_at AS valid_at, n.created_at AS invalid_at FROM involves i JOIN decisions d ON d.id = i.src LEFT JOIN supersedes s ON s.dst = i.src LEFT JOIN decisions n ON n.id = s.src"
query("j23_point_in_time", sql(f"SELECT src, dst FROM ({_STAMP}) WHERE valid_at <= TIMESTAMP '1998-06-01' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-06-01')", "involves", "decisions", "supersedes"))(
    lambda s, d: G.edges_as_of(G.stamp_supersession(B.decisions(s, d), B.involves(s, d), B.supersedes(s, d)), B.as_of("1998-06-01 00:00:00")).select("src", "dst")
)

query(
    "j27_edge_upsert",
    sql("SELECT coalesce(n.src, o.src) AS src, coalesce(n.dst, o.dst) AS dst, CASE WHEN n.src IS NULL THEN round(o.weight, 6) ELSE 0.5 END AS weight FROM involves o FULL JOIN (SELECT src, dst FROM involves WHERE src % 3 = 0 UNION SELECT src + 1000000000, dst FROM involves WHERE src % 7 = 0) n ON n.src = o.src AND n.dst = o.dst", "involves"),
)(
    lambda s, d: (
        lambda i: G.upsert_edges(i.withColumn("rel", F.lit("INVOLVES")), i.where("src % 3 = 0").select("src", "dst").union(i.where("src % 7 = 0").select(F.col("src") + 1000000000, "dst")).distinct().select("src", "dst", F.lit(0.5).alias("weight"), F.lit("INVOLVES").alias("rel"))).select("src", "dst", F.round("weight", 6).alias("weight"))
    )(B.involves(s, d))
)

# ---- counts and shares

query(
    "a01_timeline_month",
    sql(
        f""", x AS (SELECT strftime(created_at, '%Y-%m') AS period, confidence, unnest([NULL, 'scope:' || scope]) AS key FROM decisions WHERE created_at >= {NOW} - INTERVAL 360 DAY)
    SELECT period, key, count(*) AS n, round_even(avg(confidence), 3) AS avg_confidence FROM x GROUP BY 1, 2""",
        "decisions",
    ),
)(lambda s, d: M.timeline(B.decisions(s, d), "month", 12, B.as_of()))

query(
    "a01_timeline_week",
    f"""WITH x AS (SELECT strftime(ts, '%G-W%V') AS period, value / 1000 AS confidence, unnest([NULL, 'scope:' || event_type]) AS key FROM events WHERE ts >= {EVENTS_NOW} - INTERVAL 90 DAY)
    SELECT period, key, count(*) AS n, round_even(avg(confidence), 3) AS avg_confidence FROM x GROUP BY 1, 2""",
)(lambda s, d: M.timeline(B.events(s, d).select(F.col("ts").alias("created_at"), (F.col("value") / 1000).alias("confidence"), F.col("event_type").alias("scope")), "week", 3, B.as_of(B.EVENTS_AS_OF)))

_COVER = f"""SELECT f.file, count(DISTINCT d.id) AS decisions, CAST(floor((epoch({NOW}) - epoch(max(d.created_at))) / 86400) AS BIGINT) AS days_since, coalesce(floor((epoch({NOW}) - epoch(max(d.created_at))) / 86400) > 90, false) AS is_stale
    FROM files f LEFT JOIN affects a ON a.dst = f.file LEFT JOIN decisions d ON d.id = a.src GROUP BY 1"""
query("a02_coverage", sql(_COVER, "files", "affects", "decisions"))(lambda s, d: M.coverage(B.files(s, d), B.decisions(s, d), B.affects(s, d), B.as_of()))
query(
    "a02_coverage_stats",
    sql(f", c AS ({_COVER}) SELECT count(*) AS files, count(*) FILTER (decisions > 0) AS covered, count(*) FILTER (decisions = 0) AS uncovered, count(*) FILTER (is_stale) AS stale, round_even(count(*) FILTER (decisions = 0) / count(*), 3) AS debt FROM c", "files", "affects", "decisions"),
)(lambda s, d: M.coverage_stats(M.coverage(B.files(s, d), B.decisions(s, d), B.affects(s, d), B.as_of())))

query("a03_dashboard", sql("SELECT (SELECT count(*) FROM decisions) AS decisions, (SELECT count(*) FROM decisions WHERE human_rationale IS NULL) AS needs_review, (SELECT count(*) FROM entities) AS entities, (SELECT count(DISTINCT conv_id) FROM messages) AS sessions", "decisions", "entities", "messages"))(
    lambda s, d: M.dashboard_stats(B.decisions(s, d), B.entities(s, d), B.messages(s, d))
)
query("a03_newest", sql("SELECT id FROM decisions ORDER BY created_at DESC, id DESC LIMIT 6", "decisions"))(lambda s, d: M.newest(B.decisions(s, d)).select("id"))
query("a04_graph_stats", sql("SELECT (SELECT count(*) FROM decisions) AS decisions, (SELECT count(*) FROM edges WHERE rel <> 'RELATED_TO') AS edges, (SELECT count(DISTINCT dst) FROM involves) AS linked_entities", "decisions", "edges"))(lambda s, d: M.graph_stats(B.decisions(s, d), B.entities(s, d), B.edges(s, d)))
query("a05_rel_counts", sql("SELECT rel, count(*) AS n FROM edges WHERE src IN (SELECT id FROM decisions) GROUP BY 1", "edges", "decisions"))(lambda s, d: M.rel_counts(B.decisions(s, d), B.edges(s, d)))
query("a06_source_counts", sql("SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM decisions GROUP BY 1", "decisions"))(lambda s, d: M.source_counts(B.decisions(s, d)))
query("a07_project_counts", sql("SELECT coalesce(project_name, 'unassigned') AS project_name, count(*) AS n FROM decisions GROUP BY 1", "decisions"))(lambda s, d: M.project_counts(B.decisions(s, d)))
query("a08_project_list", sql("SELECT project_name, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at, count(*) AS n FROM decisions WHERE project_name IS NOT NULL GROUP BY 1", "decisions"))(lambda s, d: M.project_list(B.decisions(s, d)).select("project_name", text("first_at"), "n"))
query("a09_project_stats", sql("SELECT project_name, count(DISTINCT d.id) AS n, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at, count(DISTINCT dst) AS entities FROM decisions d LEFT JOIN involves i ON i.src = d.id WHERE project_name IS NOT NULL GROUP BY 1", "decisions", "involves"))(
    lambda s, d: M.project_stats(B.decisions(s, d), B.involves(s, d)).select("project_name", "n", text("last_at"), "entities")
)
query("a10_top_entities", sql("SELECT e.id, e.name, e.type, count(DISTINCT src) AS decisions FROM involves i JOIN entities e ON e.id = i.dst GROUP BY 1, 2, 3 ORDER BY decisions DESC, e.id LIMIT 15", "involves", "entities"))(lambda s, d: M.top_entities(B.entities(s, d), B.involves(s, d)).select("id", "name", "type", "decisions"))
query(
    "a11_top_decisions",
    sql(
        """, t AS (SELECT d.id, round(0.4 * coalesce(confidence, 0) + 0.3 * coalesce(n, 0) / 10 + 0.3, 6) AS score FROM decisions d LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM involves GROUP BY 1) i ON i.src = d.id ORDER BY score DESC, d.id LIMIT 10)
    SELECT id, score, id NOT IN (SELECT dst FROM supersedes) AS is_current FROM t""",
        "decisions", "involves", "supersedes",
    ),
)(lambda s, d: M.top_decisions(B.decisions(s, d), B.involves(s, d), B.supersedes(s, d)))
query("a12_knowledge_gaps", sql("SELECT type, count(DISTINCT d.id) AS decisions, round(avg(confidence), 6) AS avg_confidence FROM involves i JOIN entities e ON e.id = i.dst JOIN decisions d ON d.id = i.src GROUP BY 1 HAVING count(DISTINCT d.id) <= 2 OR round(avg(confidence), 6) < 0.6 ORDER BY decisions, type LIMIT 10", "involves", "entities", "decisions"))(
    lambda s, d: M.knowledge_gaps(B.decisions(s, d), B.entities(s, d), B.involves(s, d))
)
query("a13_daily_activity", f"SELECT strftime(g.d, '%Y-%m-%d') AS day, count(e.ts) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-19', DATE '2024-02-01', INTERVAL 1 DAY)) AS d) g LEFT JOIN events e ON date_trunc('day', e.ts) = g.d GROUP BY 1")(
    lambda s, d: M.daily_activity(B.events(s, d).select(F.col("ts").alias("created_at")), B.as_of(B.EVENTS_AS_OF)).select(F.col("day").cast("string").alias("day"), "n")
)
query("a14_entity_types", sql("SELECT coalesce(type, 'other') AS type, count(*) AS n FROM involves i LEFT JOIN entities e ON e.id = i.dst GROUP BY 1", "involves", "entities"))(lambda s, d: M.entity_type_distribution(B.entities(s, d), B.involves(s, d)))
query("a15_confidence_histogram", sql("SELECT CAST(least(floor(confidence * 5), 4) AS INTEGER) AS bin, count(*) AS n FROM decisions GROUP BY 1", "decisions"))(lambda s, d: M.confidence_histogram(B.decisions(s, d)))
query("a16_quick_stats", sql(f"SELECT round(100 * avg(confidence), 0) AS confidence_percent, count(*) FILTER (created_at >= {NOW} - INTERVAL 7 DAY) AS last_week, (SELECT count(DISTINCT dst) FROM involves) AS entities, round((SELECT count(*) FROM involves) / count(*), 1) AS entities_per_decision FROM decisions", "decisions", "involves"))(
    lambda s, d: M.quick_stats(B.decisions(s, d), B.involves(s, d), B.as_of())
)
query("a17_month_groups", sql("SELECT id, strftime(created_at, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m') ORDER BY created_at DESC, id DESC) AS place FROM decisions", "decisions"))(lambda s, d: M.month_order(B.decisions(s, d)).withColumn("place", F.col("place").cast("bigint")))
query(
    "a18_dormant_tiers",
    sql(f", r AS (SELECT CAST(floor((epoch({NOW}) - epoch(created_at)) / 86400) AS BIGINT) AS days, round_even(0.6 * least(floor((epoch({NOW}) - epoch(created_at)) / 86400) / 365, 1) + 0.4 * (1 - confidence), 3) AS score FROM decisions) SELECT CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n, max(days) AS longest_days FROM r GROUP BY 1", "decisions"),
)(
    lambda s, d: M.dormant_tiers(
        B.decisions(s, d).withColumn("days", M.days_between(B.as_of(), F.col("created_at"))).withColumn("score", F.bround(0.6 * F.least(F.col("days") / 365, F.lit(1.0)) + 0.4 * (1 - F.col("confidence")), 3))
    )
)
query("a19_alias_mining", "SELECT regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS slug, count(DISTINCT lower(x)) AS n FROM (SELECT p_brand AS x FROM part UNION ALL SELECT replace(p_brand, '#', ' ') FROM part) WHERE length(regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) > 2 GROUP BY 1 HAVING count(DISTINCT lower(x)) >= 2")(
    lambda s, d: (lambda p: M.mine_aliases(p.select(F.col("p_brand").alias("name")).unionByName(p.select(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")).alias("name"))).withColumn("type", F.lit("technology")), ["technology"]).select("slug", "n"))(B.table(s, d, "part"))
)
query("a20_usage_rollup", "SELECT event_type AS model, count(*) AS calls, sum(user_id)::BIGINT AS prompt_tokens, sum(event_id % 500)::BIGINT AS completion_tokens, round((sum(user_id) * 0.30 + sum(event_id % 500) * 2.50) / 1e6, 6) AS cost_usd FROM events GROUP BY 1")(
    lambda s, d: M.usage_rollup(B.events(s, d).select(F.col("event_type").alias("model"), F.col("user_id").alias("prompt_tokens"), (F.col("event_id") % 500).alias("completion_tokens"), F.col("value").alias("latency"))).drop("avg_latency")
)
query("a21_resolution_summary", "SELECT event_type AS method, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS new FROM events GROUP BY 1")(lambda s, d: M.resolution_summary(B.events(s, d).select(F.col("event_type").alias("method"), (F.col("event_id") % 3 == 0).alias("is_new"))))
query("a22_extraction_summary", sql("SELECT user_id, count(*) AS n, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most FROM decisions GROUP BY 1", "decisions"))(
    lambda s, d: M.extraction_summary(B.decisions(s, d).withColumn("raw_confidence", F.col("confidence"))).select("user_id", "n", "mean", "least", "most")
)
query("a23_user_profile", sql("SELECT c_custkey AS user_id, (SELECT count(*) FROM decisions d WHERE d.user_id = c_custkey) AS decisions, (SELECT count(DISTINCT date_trunc('day', ts)) FROM events e WHERE e.user_id = c_custkey) AS sessions FROM customer", "decisions"))(
    lambda s, d: M.user_profile(B.table(s, d, "customer").select(F.col("c_custkey").alias("user_id")), B.decisions(s, d), B.events(s, d).select("user_id", F.to_date("ts").alias("session")))
)
query("a25_import_progress", "SELECT l_suppkey AS job, count(*) AS files, count(*) FILTER (l_linestatus = 'F') AS done, count(*) FILTER (l_linestatus = 'O') AS errors, CAST(sum(l_linenumber) AS BIGINT) AS decisions, round(count(*) FILTER (l_linestatus = 'F') / count(*), 6) AS share FROM lineitem GROUP BY 1")(
    lambda s, d: M.import_progress(B.table(s, d, "lineitem").select(F.col("l_suppkey").alias("job"), F.when(F.col("l_linestatus") == "F", "done").when(F.col("l_linestatus") == "O", "error").alias("status"), F.col("l_linenumber").alias("decisions")))
)
query("a26_entity_list", sql("SELECT DISTINCT name FROM entities WHERE id IN (SELECT dst FROM involves) ORDER BY name LIMIT 100", "entities", "involves"))(lambda s, d: M.entity_list(B.entities(s, d), B.involves(s, d), B.decisions(s, d)))
query("a28_event_counters", "SELECT event_type, CAST((value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: M.event_counters(B.events(s, d), ["event_type"], "value", [10.0, 50.0, 100.0]).drop("total"))

_NOTES = "SELECT event_id AS id, user_id, ts AS created_at, event_id % 4 = 0 AS read FROM events"
query("a27_inbox", f"WITH n AS ({_NOTES}) SELECT user_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS place FROM n WHERE NOT read) WHERE place <= 5")(
    lambda s, d: M.inbox(B.events(s, d).select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), (F.col("event_id") % 4 == 0).alias("read")), 5, True).select("user_id", "id", F.col("place").cast("bigint").alias("place"))
)
query("a27_unread_counts", f"WITH n AS ({_NOTES}) SELECT user_id, least(200, count(*) FILTER (NOT read)) AS unread FROM n GROUP BY 1")(lambda s, d: M.unread_counts(B.events(s, d).select("user_id", (F.col("event_id") % 4 == 0).alias("read"))))

# ---- time rules

query("r01_paging", sql("SELECT id, rank, (SELECT count(*) FROM decisions) AS total FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM decisions) WHERE rank BETWEEN 41 AND 60", "decisions"))(lambda s, d: R.paginate(B.decisions(s, d), 3, 20).select("id", F.col("rank").cast("bigint").alias("rank"), "total"))

_OPTIONS = "SELECT id, unnest(['Ship with status O', 'Ship with status F', 'Ship with status P']) AS text, generate_subscripts(['a', 'b', 'c'], 1) - 1 AS pos, agent_decision FROM decisions"


def _with_options(s: SparkSession, d: str) -> DataFrame:
    return B.decisions(s, d).withColumn("options", F.array(*[F.lit(f"Ship with status {x}") for x in "OFP"]))


query("r03_candidates", sql(f", o AS ({_OPTIONS}) SELECT sha256(concat_ws('|', CAST(id AS VARCHAR), CAST(pos AS VARCHAR))) AS id, id AS decision_id, text FROM o WHERE lower(text) <> coalesce(lower(agent_decision), '')", "decisions"))(lambda s, d: R.rejected_candidates(_with_options(s, d)))

query(
    "r02_dormant_alternatives",
    sql(
        f""", o AS ({_OPTIONS}), c AS (SELECT o.*, d.user_id, d.created_at, d.confidence, CAST(floor((epoch({NOW}) - epoch(d.created_at)) / 86400) AS BIGINT) AS days FROM o JOIN decisions d USING (id) WHERE lower(text) <> coalesce(lower(o.agent_decision), ''))
    SELECT id AS decision_id, text, days, round(0.6 * least(days / 365, 1) + 0.4 * (1 - confidence), 6) AS score FROM c
    WHERE days >= 14 AND NOT EXISTS (SELECT 1 FROM decisions l WHERE l.user_id = c.user_id AND l.created_at > c.created_at AND l.agent_decision IS NOT NULL AND (contains(lower(l.agent_decision), lower(c.text)) OR contains(lower(c.text), lower(l.agent_decision))))""",
        "decisions",
    ),
)(lambda s, d: (lambda x: R.dormant_alternatives(R.rejected_candidates(x), x, B.as_of(), limit=None, places=6).select("decision_id", "text", "days", "score"))(_with_options(s, d)))

_LIMIT = "CASE scope WHEN 'strategic' THEN 730 WHEN 'library' THEN 90 WHEN 'config' THEN 30 WHEN 'operational' THEN 14 ELSE 90 END"
_DAYS = f"CAST(floor((epoch({NOW}) - epoch(coalesce(last_reviewed_at, created_at))) / 86400) AS BIGINT)"
query("r04_stale_decisions", sql(f"SELECT id, scope, {_DAYS} AS days, {_DAYS} - {_LIMIT} AS overdue FROM decisions WHERE {_DAYS} - {_LIMIT} > 0 ORDER BY overdue DESC, id LIMIT 50", "decisions"))(lambda s, d: R.stale_decisions(B.decisions(s, d), B.as_of()))
query("r05_stale_flag", sql(f"SELECT id, floor((epoch({NOW}) - epoch(created_at)) / 86400) > {_LIMIT} AS stale FROM decisions", "decisions"))(lambda s, d: B.decisions(s, d).select("id", R.is_stale(B.as_of()).alias("stale")))
query("r06_stale_files", sql(f"SELECT file, CAST(floor((epoch({FILES_NOW}) - epoch(last_modified)) / 86400) AS BIGINT) AS days_since FROM files WHERE last_modified < {FILES_NOW} - INTERVAL 90 DAY", "files"))(lambda s, d: R.stale_files(B.files(s, d), B.as_of(B.FILES_AS_OF)))
query("r09_file_last_modified", sql("SELECT file, strftime(max(committed_at), '%Y-%m-%d %H:%M:%S') AS last_modified FROM (SELECT unnest(files_changed) AS file, committed_at FROM commits) GROUP BY 1", "commits"))(
    lambda s, d: R.file_last_modified(B.commits(s, d)).select("file", text("last_modified"))
)
query("r10_token_budget", "SELECT doc_id, CAST(spent AS BIGINT) AS spent FROM (SELECT doc_id, sum(length(text) // 4) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM documents) WHERE spent <= 4000")(
    lambda s, d: R.within_budget(B.table(s, d, "documents"), ["source"], [F.col("n_chars"), F.col("doc_id")], F.length("text"), 4000).select("doc_id", F.col("spent").cast("bigint").alias("spent"))
)
query("r11_truncate_recent", sql("SELECT conv_id, turn_index, CAST(k AS BIGINT) AS kept_chars FROM (SELECT *, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY turn_index DESC ROWS UNBOUNDED PRECEDING) AS k FROM messages) WHERE k <= 2000", "messages"))(
    lambda s, d: R.truncate_recent(B.messages(s, d), 2000).select("conv_id", "turn_index", F.col("kept_chars").cast("bigint").alias("kept_chars"))
)
query(
    "r12_batch_packing",
    sql(
        """, m AS (SELECT conv_id, turn_index, CAST(length(content) // 4 + 1 AS INTEGER) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index) AS r FROM messages)
    SELECT conv_id, turn_index, batch FROM (WITH RECURSIVE w AS (SELECT conv_id, turn_index, r, 1 AS batch, 1 AS items, s AS tokens FROM m WHERE r = 1
      UNION ALL SELECT m.conv_id, m.turn_index, m.r, CASE WHEN items < 3 AND tokens + s <= 500 THEN batch ELSE batch + 1 END, CASE WHEN items < 3 AND tokens + s <= 500 THEN items + 1 ELSE 1 END, CASE WHEN items < 3 AND tokens + s <= 500 THEN tokens + s ELSE s END
      FROM w JOIN m ON m.conv_id = w.conv_id AND m.r = w.r + 1) SELECT * FROM w)""",
        "messages",
    ),
)(lambda s, d: R.pack_batches(B.messages(s, d), "conv_id", "turn_index", "content", 3, 500))
query(
    "r13_notifications",
    sql(
        """, x AS (SELECT DISTINCT d.user_id, c.o AS subject FROM (SELECT src AS id, dst AS o FROM contradicts UNION SELECT dst, src FROM contradicts) c JOIN decisions d ON d.id = c.id)
    SELECT 'contradiction' AS type, user_id, subject, 'A decision of yours contradicts decision ' || subject AS text FROM x""",
        "contradicts", "decisions",
    ),
)(lambda s, d: R.notify_contradictions(B.contradicts(s, d), B.decisions(s, d)).select("type", "user_id", "subject", "text"))


def _assumed(s: SparkSession, d: str) -> DataFrame:
    """Decisions with texts about their scope that oppose each other now and then."""
    p = F.col("id") % 4
    return B.decisions(s, d).withColumns(
        {
            "assumptions": F.array(F.concat(F.lit("we stay on postgres for "), F.col("scope"), F.lit(" and under "), (F.col("id") % 90 + 10).cast("string"), F.lit(" users"))),
            "trigger": F.when(p == 0, F.lit("mongodb fits better")).when(p == 1, F.concat(F.lit("now "), (F.col("id") % 9000).cast("string"), F.lit(" users"))).when(p == 2, F.lit("the postgres layer is deprecated")).otherwise(F.lit("nothing new")),
        }
    )


query(
    "r07_assumption_violations",
    sql(
        """, x AS (SELECT id, user_id, created_at, 'we stay on postgres for ' || scope || ' and under ' || (id % 90 + 10) || ' users' AS assumption, id % 90 + 10 AS had,
      CASE id % 4 WHEN 0 THEN 'mongodb fits better' WHEN 1 THEN 'now ' || (id % 9000) || ' users' WHEN 2 THEN 'the postgres layer is deprecated' ELSE 'nothing new' END || ' ' || context || ' ' || coalesce(agent_decision, '') AS later_text FROM decisions),
    p AS (SELECT a.id, a.assumption, l.id AS later_id, a.had, l.later_text, row_number() OVER (PARTITION BY a.id ORDER BY l.created_at, l.id) AS r FROM x a JOIN x l ON a.user_id = l.user_id AND l.created_at > a.created_at),
    h AS (SELECT *, CASE WHEN later_id % 4 = 2 THEN 0.75 WHEN later_id % 4 = 0 THEN 0.80 WHEN later_id % 4 = 1 AND later_id % 9000 >= had * 10 THEN 0.70 END AS confidence FROM p WHERE r <= 50)
    SELECT id, assumption, arg_min(later_id, r) AS later_id, arg_min(confidence, r) AS confidence FROM h WHERE confidence IS NOT NULL GROUP BY 1, 2""",
        "decisions",
    ),
)(lambda s, d: R.assumption_violations(_assumed(s, d)).select("id", "assumption", "later_id", F.col("confidence").cast("double").alias("confidence")))

"""Patterns over decisions, entities and edges as joins.

Edge tables have (src, dst[, rel, ...]). A lookup for some keys is a join with a table of those keys, so
every operator answers for all keys at once. Sides that are joined to wide rows are aggregated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fold, jaccard
from ..functions.tables import settled, tasks_for, tasks_over

ENTITY_RELS = ["IS_A", "PART_OF", "DEPENDS_ON", "RELATED_TO", "ALTERNATIVE_TO", "ENABLES", "PREVENTS", "REQUIRES", "REFINES"]


def of(edges: DataFrame, *rels: str) -> DataFrame:
    return edges.where(F.col("rel").isin(*rels))


def decisions_with_entities(decisions: DataFrame, entities: DataFrame, involves: DataFrame) -> DataFrame:
    """Each decision with entities array<(id, name, type)> in the order of ids; empty where none."""
    e = entities.select(F.col("id").alias("dst"), F.struct("id", "name", "type").alias("e"))
    own = involves.select("src", "dst").distinct().join(e, "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("e")).alias("entities"))
    empty = F.array().cast(own.schema["entities"].dataType)
    return decisions.join(own, "id", "left").withColumn("entities", F.coalesce("entities", empty))


def paged(df: DataFrame, page: int, size: int) -> DataFrame:
    w = Window.orderBy(F.desc("created_at"), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(w)).where((F.col("rank") > (page - 1) * size) & (F.col("rank") <= page * size))


def page_of(df: DataFrame, page: int, size: int) -> DataFrame:
    """The same rows without a global window: a bounded top-k, then the window over page * size rows."""
    return paged(df.orderBy(F.desc("created_at"), F.asc("id")).limit(page * size), page, size)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def graph_page(decisions: DataFrame, involves: DataFrame, edges: DataFrame, page: int, size: int) -> DataFrame:
    """(kind, src, dst): the page's decisions, their entities and the edges between these, as one table."""
    d = page_of(decisions, page, size).select("id")
    e = involves.join(d.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst").distinct()
    none = F.lit(None).cast("bigint")
    nodes = d.select(F.lit("decision").alias("kind"), F.col("id").alias("src"), none.alias("dst")).unionByName(e.select(F.lit("entity").alias("kind"), F.col("dst").alias("src"), none.alias("dst")).distinct())
    between = induced(d, edges).select(F.col("rel").alias("kind"), "src", "dst")
    return nodes.unionByName(e.select(F.lit("INVOLVES").alias("kind"), "src", "dst")).unionByName(between)


def within(edges: DataFrame, nodes: DataFrame, *ends: str) -> DataFrame:
    """Edges of a settled table whose `ends` are among settled nodes (id), in tasks of a bounded number of edges."""
    parts = tasks_for(edges)
    for c in ends:
        edges = edges.repartition(parts, c).join(nodes.select(F.col("id").alias(c)), c, "left_semi")
    return edges


def full_graph(decisions: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges of the visible graph; entity edges need a source that a visible decision involves."""
    e, d = settled(edges.select("src", "dst", "rel")), settled(decisions.select("id").distinct())
    # an entity that a visible decision involves is kept, so these edges need no list of the kept
    inv = settled(within(settled(within(of(e, "INVOLVES"), d, "src")), entities, "dst").select("src", "dst", "rel"))
    kept = settled(inv.select(F.col("dst").alias("id")).distinct())
    between = within(e.where(~F.col("rel").isin("INVOLVES", *ENTITY_RELS)), d, "src", "dst")
    related = within(of(e, *ENTITY_RELS), kept, "src", "dst")
    return inv.unionByName(between.select("src", "dst", "rel")).unionByName(related.select("src", "dst", "rel"))


def symmetric(edges: DataFrame, *extra: str) -> DataFrame:
    """(id, other, direction, extra) both ways."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("outgoing").alias("direction"), *extra)
    return out.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("incoming").alias("direction"), *extra))


def neighbors(edges: DataFrame, ids: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """(id, direction, rel, other): at most `limit` for each id and direction, by relationship and id."""
    both = symmetric(edges, "rel").distinct()
    if ids is not None:
        both = both.join(ids.select("id").distinct(), "id", "left_semi")
    w = Window.partitionBy("id", "direction").orderBy("rel", "other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("id", "direction", "rel", "other")


def visible_entities(entities: DataFrame, involves: DataFrame, decisions: DataFrame) -> DataFrame:
    seen = involves.join(decisions.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return entities.join(seen, "id", "left_semi")


def _ids(edges: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return edges.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_set(value)).alias(name))


def node_details(decisions: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, entity_names, supersedes, contradicts): each side aggregated by itself, so nothing fans out."""
    inv = of(edges, "INVOLVES").select("src", "dst").join(entities.select(F.col("id").alias("dst"), "name"), "dst")
    out = decisions.select("id").join(_ids(inv, "src", "name", "entity_names"), "id", "left")
    out = out.join(_ids(of(edges, "SUPERSEDES"), "src", "dst", "supersedes"), "id", "left")
    return out.join(_ids(symmetric(of(edges, "CONTRADICTS")), "id", "other", "contradicts"), "id", "left")


def shared_entity_pairs(involves: DataFrame, min_shared: int = 1) -> DataFrame:
    """(a, b, shared) of decisions a < b. A hub's pairs grow with the square of its degree where one shared entity is enough.

    For more, decisions meet in all but the min_shared - 1 most frequent of their entities: of the entities that a pair
    shares, in the order of frequency, the first has as many after it in both. Each pair is judged where that first one
    is met, by the lists of entities that travel with the decisions, so nothing is counted after the join.
    """
    i = involves.select("src", "dst").distinct()
    if min_shared == 1:
        pairs = i.select(F.col("src").alias("a"), "dst").join(i.select(F.col("src").alias("b"), "dst"), "dst").where("a < b")
        return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    index = overlap_index(i, min_shared)
    met = index.toDF("dst", "a", "of_a").join(index.toDF("dst", "b", "of_b"), "dst").where("a < b")
    common = F.array_intersect("of_a", "of_b")
    met = met.select("a", "b", "dst", common.alias("common")).where((F.size("common") >= min_shared) & (F.get("common", F.lit(0)) == F.col("dst")))
    return met.select("a", "b", F.size("common").cast("bigint").alias("shared"))


def overlap_index(involves: DataFrame, min_shared: int) -> DataFrame:
    """(dst, src, all): each decision under its entities but the min_shared - 1 most frequent; all of them, the rarest first."""
    degree = involves.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    lists = involves.join(degree, "dst").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("degree", "dst"))).alias("x"))
    lists = lists.where(F.size("x") >= min_shared).select("src", F.transform("x", lambda e: e["dst"]).alias("all"))
    return lists.select(F.explode(F.slice("all", F.lit(1), F.size("all") - (min_shared - 1))).alias("dst"), "src", "all")


def influenced_by(decisions: DataFrame, involves: DataFrame, min_shared: int = 2) -> DataFrame:
    """(src newer, dst older, shared)."""
    p = shared_entity_pairs(involves, min_shared)
    t = decisions.select("id", "created_at")
    p = p.join(t.select(F.col("id").alias("a"), F.col("created_at").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("created_at").alias("tb")), "b").where("ta <> tb")
    newer = F.col("ta") > F.col("tb")
    return p.select(F.when(newer, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(newer, F.col("b")).otherwise(F.col("a")).alias("dst"), "shared")


def temporal_edges(decisions: DataFrame) -> DataFrame:
    """FOLLOWS and PRECEDES between all turns of one user and project."""
    d = decisions.where("turn_index IS NOT NULL").select("id", "user_id", "project_name", "turn_index")
    o = d.select(F.col("id").alias("old"), "user_id", "project_name", F.col("turn_index").alias("old_turn"))
    pairs = d.join(o, ["user_id", "project_name"]).where("old_turn < turn_index")
    return pairs.select(F.col("id").alias("src"), F.col("old").alias("dst"), F.lit("FOLLOWS").alias("rel")).unionByName(pairs.select(F.col("old").alias("src"), F.col("id").alias("dst"), F.lit("PRECEDES").alias("rel")))


def name_keys(entities: DataFrame) -> DataFrame:
    """(key, id): folded names and aliases."""
    names = F.array(F.col("name"))
    if "aliases" in entities.columns:
        names = F.concat(names, F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select("id", F.explode(names).alias("n")).select(fold("n").alias("key"), "id").where("key <> ''").distinct()


def entity_timeline(names: DataFrame, entities: DataFrame, involves: DataFrame, decisions: DataFrame, supersedes: DataFrame, contradicts: DataFrame) -> DataFrame:
    """(name, id, created_at, position, supersedes, contradicts) for each asked name."""
    hit = names.select("name", fold("name").alias("key")).distinct().join(name_keys(entities), "key").select("name", F.col("id").alias("dst"))
    d = involves.select("src", "dst").join(hit, "dst").select("name", F.col("src").alias("id")).distinct().join(decisions.select("id", "created_at"), "id")
    d = d.join(_ids(supersedes, "src", "dst", "supersedes"), "id", "left").join(_ids(symmetric(contradicts), "id", "other", "contradicts"), "id", "left")
    return d.withColumn("position", F.row_number().over(Window.partitionBy("name").orderBy("created_at", "id")))


def decision_evolution(decisions: DataFrame, influenced: DataFrame, supersedes: DataFrame) -> DataFrame:
    """(id, influenced_by, supersedes, superseded_by): sorted ids."""
    out = decisions.select("id").join(_ids(influenced, "src", "dst", "influenced_by"), "id", "left")
    return out.join(_ids(supersedes, "src", "dst", "supersedes"), "id", "left").join(_ids(supersedes, "dst", "src", "superseded_by"), "id", "left")


def supersession_chains(supersedes: DataFrame, ids: DataFrame, max_hops: int = 3, most: int | None = 5) -> DataFrame:
    """(start, end, hops, path): simple paths that start at a given id; at most `most` for each start, the shortest first."""
    e = settled(supersedes.select("src", "dst"))
    parts = tasks_over(e)
    walk = e.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.lit(1).alias("hops"), F.array("src", "dst").alias("path"))
    out = walk
    for hop in range(2, max_hops + 1):
        walk = walk.repartition(parts, "end").join(e.repartition(parts, "src"), F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("end"), F.lit(hop).alias("hops"), F.array_append("path", F.col("dst")).alias("path"))
        out = out.unionByName(walk)
    if most is None:
        return out
    w = Window.partitionBy("start").orderBy("hops", "end")
    return out.repartition(parts * max_hops, "start").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def contradictions(contradicts: DataFrame) -> DataFrame:
    return symmetric(contradicts).select("id", "other").distinct()


def unresolved_contradictions(contradicts: DataFrame, supersedes: DataFrame) -> DataFrame:
    """(a, b) with a < b where neither side is superseded."""
    old = supersedes.select("dst").distinct()
    pairs = contradicts.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(old.withColumnRenamed("dst", "a"), "a", "left_anti").join(old.withColumnRenamed("dst", "b"), "b", "left_anti").select("a", "b")


def abandoned_patterns(names: DataFrame, entities: DataFrame, involves: DataFrame, supersedes: DataFrame) -> DataFrame:
    """(name, old, successor): superseded decisions that involve an entity of a given name."""
    hit = entities.join(names.select("name").distinct(), "name", "left_semi").select(F.col("id").alias("dst"), "name")
    d = involves.select("src", "dst").join(hit, "dst").select("name", F.col("src").alias("old")).distinct()
    return d.join(supersedes.select(F.col("dst").alias("old"), F.col("src").alias("successor")), "old")


def with_currency(decisions: DataFrame, supersedes: DataFrame) -> DataFrame:
    gone = supersedes.select(F.col("dst").alias("id"), F.lit(False).alias("is_current")).distinct()
    return decisions.join(gone, "id", "left").withColumn("is_current", F.coalesce("is_current", F.lit(True)))


def entity_status(involves: DataFrame, decisions: DataFrame, supersedes: DataFrame) -> DataFrame:
    d = with_currency(decisions.select("id"), supersedes)
    per = involves.select(F.col("src").alias("id"), "dst").distinct().join(d, "id").groupBy(F.col("dst").alias("entity")).agg(F.every("is_current").alias("every"), F.some("is_current").alias("any"))
    return per.select("entity", F.when(F.col("every"), "active").when(F.col("any"), "partially_superseded").otherwise("superseded").alias("status"))


def link_commits(sessions: DataFrame, commits: DataFrame, hours: int = 2, threshold: float = 0.3) -> DataFrame:
    """(session, sha, score): commits within `hours` of a session's start whose files overlap by Jaccard.

    Two that overlap share a file, so they meet on a file and a slot of `hours`: a session is sent to its own slot and
    the next, which its window touches. Only where no overlap is asked for they meet on slots alone.
    """
    width = max(hours * 3600, 1)
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    s = sessions.select("session", F.col("ts").alias("start"), F.array_distinct("files").alias("session_files"), F.explode(F.array(slot("ts"), slot("ts") + 1)).alias("slot"))
    c = commits.select("sha", "committed_at", F.array_distinct("files_changed").alias("files_changed"), slot("committed_at").alias("slot"))
    near = (F.col("committed_at") >= F.col("start")) & (F.col("committed_at") <= F.col("start") + F.make_dt_interval(F.lit(0), F.lit(hours)))
    if threshold <= 0:
        return s.join(c, "slot").where(near).select("session", "sha", jaccard("session_files", "files_changed").alias("score")).where(F.col("score") >= threshold)
    s = s.select("session", "start", "slot", F.size("session_files").alias("n"), F.explode("session_files").alias("file"))
    c = c.select("sha", "committed_at", "slot", F.size("files_changed").alias("m"), F.explode("files_changed").alias("changed"))
    # the ratio of the sizes bounds the score
    least = threshold * (1 - 1e-9)
    like = (F.col("n") >= least * F.col("m")) & (F.col("m") >= least * F.col("n"))
    # exploded rows are more than Spark takes them for: no broadcast
    met = s.join(c.hint("merge"), (s.slot == c.slot) & F.col("file").eqNullSafe(F.col("changed"))).where(near & like)
    both = met.groupBy("session", "start", "n", "sha", "committed_at", "m").agg(F.count(F.lit(1)).alias("both"))
    return both.select("session", "sha", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("score")).where(F.col("score") >= threshold)


def link_decisions(decisions: DataFrame, affects: DataFrame, commits: DataFrame, hours: int = 2, threshold: float = 0.3, k: int = 20) -> DataFrame:
    """(sha, id, overlap, score): decisions made in the `hours` before a commit that affect its files.

    Both meet on a file and a slot of `hours`: a decision is sent to its own slot and the next, which its window touches.
    """
    width = max(hours * 3600, 1)
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    files = commits.select("sha", "committed_at", F.size("files_changed").alias("n_files"), F.explode("files_changed").alias("dst"), slot("committed_at").alias("slot"))
    made = affects.select(F.col("src").alias("id"), "dst").distinct().join(decisions.select("id", "created_at", F.explode(F.array(slot("created_at"), slot("created_at") + 1)).alias("slot")), "id")
    near = files.join(made.hint("merge"), ["dst", "slot"])
    near = near.where((F.col("created_at") <= F.col("committed_at")) & (F.col("created_at") >= F.col("committed_at") - F.make_dt_interval(F.lit(0), F.lit(hours))))
    found = near.groupBy("sha", "id", "n_files").agg(F.count(F.lit(1)).alias("overlap")).withColumn("score", F.col("overlap") / F.col("n_files"))
    w = Window.partitionBy("sha").orderBy(F.desc("overlap"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") >= threshold)).select("sha", "id", "overlap", "score")


def change_context(changes: DataFrame, decisions: DataFrame, affects: DataFrame, contradicts: DataFrame, stale: Column, k: int = 50) -> DataFrame:
    """(change, id, is_stale, contradicts) for changes (change, file): the newest k decisions on its files."""
    d = changes.select("change", F.col("file").alias("dst")).distinct().join(affects, "dst").select("change", F.col("src").alias("id")).distinct().join(decisions, "id")
    w = Window.partitionBy("change").orderBy(F.desc("created_at"), F.desc("id"))
    top = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("change", "id", stale.alias("is_stale"))
    pairs = top.select("change", "id").join(contradictions(contradicts), "id").join(top.select("change", F.col("id").alias("other")), ["change", "other"])
    return top.join(pairs.groupBy("change", "id").agg(F.sort_array(F.collect_set("other")).alias("contradicts")), ["change", "id"], "left")


def touches(commits: DataFrame) -> DataFrame:
    return commits.select(F.col("sha").alias("src"), F.explode("files_changed").alias("dst")).distinct()


def cross_user_pairs(new: DataFrame, decisions: DataFrame, n: int = 20) -> DataFrame:
    """(id, other): for each new decision the newest n of other users in its project.

    Only the newest n of each (project, user) can be among the newest n of others, so the join meets those alone.
    """
    top = Window.partitionBy("project_name", "user_id").orderBy(F.desc("created_at"), F.desc("id"))
    d = decisions.where("user_id IS NOT NULL AND project_name IS NOT NULL").withColumn("r", F.row_number().over(top)).where(F.col("r") <= n)
    # of a project, the newest n of a user that differs are within the newest n * (n + 1) rows of distinct users taken in order
    d = d.select(F.col("id").alias("other"), F.col("user_id").alias("other_user"), "project_name", F.col("created_at").alias("at"))
    pool = Window.partitionBy("project_name").orderBy(F.desc("at"), F.desc("other"))
    d = d.withColumn("p", F.row_number().over(pool))
    # a project's pool is one array of at most 2 * n rows, so a new decision meets one row and nothing is ranked after the join
    pools = d.where(F.col("p") <= 2 * n).groupBy("project_name").agg(F.sort_array(F.collect_list(F.struct("p", "other", "other_user"))).alias("pool"))
    own = new.where("user_id IS NOT NULL").select("id", "user_id", "project_name").join(pools, "project_name")
    first = F.slice(F.filter("pool", lambda x: x["other_user"] != F.col("user_id")), 1, n)
    return own.select("id", F.posexplode(first).alias("rank", "x")).select("id", F.col("x.other").alias("other"), (F.col("rank") + 1).alias("rank"))


def related_entities(entities: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(id, related): up to k names of neighbours, in the order of names."""
    n = symmetric(edges).select("id", "other").join(entities.select(F.col("id").alias("other"), "name"), "other").select("id", "name").distinct()
    w = Window.partitionBy("id").orderBy("name")
    n = n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return n.groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("related"))


def edges_as_of(edges: DataFrame, t: Column) -> DataFrame:
    return edges.where((F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t)))


def stamp_supersession(decisions: DataFrame, involves: DataFrame, supersedes: DataFrame) -> DataFrame:
    """INVOLVES with valid_at (the decision's time) and invalid_at (the first superseder's)."""
    t = decisions.select("id", "created_at")
    end = supersedes.join(t.select(F.col("id").alias("src"), "created_at"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("created_at").alias("invalid_at"))
    start = t.select(F.col("id"), F.col("created_at").alias("valid_at")).join(end, "id", "left")
    return involves.select(F.col("src"), "dst").join(start.withColumnRenamed("id", "src"), "src")


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (src, dst, rel): the new one where both exist."""
    both = edges.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("src", "dst", "rel", "_new")]
    out = both.groupBy("src", "dst", "rel").agg(F.max(F.struct("_new", *rest)).alias("x"))
    return out.select("src", "dst", "rel", *[F.col(f"x.{c}").alias(c) for c in rest])


def verdict_edges(pairs: DataFrame, verdicts: DataFrame, decisions: DataFrame, min_conf: float = 0.6) -> DataFrame:
    """(src, dst, rel, confidence) of pairs (a, b) with a supplied verdict (a, b, verdict, confidence), each unordered pair once.

    SUPERSEDES goes from the newer decision to the older; NONE and unsure verdicts give no edge.
    """
    v = verdicts.where(F.col("verdict").isin("SUPERSEDES", "CONTRADICTS") & (F.col("confidence") >= min_conf))
    v = v.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "verdict", "confidence")
    v = v.groupBy("a", "b").agg(F.max(F.struct("confidence", "verdict")).alias("x")).select("a", "b", "x.*")
    t = decisions.select("id", "created_at")
    j = pairs.select("a", "b").join(v, ["a", "b"]).join(t.select(F.col("id").alias("a"), F.col("created_at").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("created_at").alias("tb")), "b")
    swap = (F.col("verdict") == "SUPERSEDES") & (F.col("tb") > F.col("ta"))
    return j.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("dst"), F.col("verdict").alias("rel"), "confidence")


def shared_entity_groups(decisions: DataFrame, involves: DataFrame, min_shared: int = 2) -> DataFrame:
    """(id, component) of decisions that are connected through pairs sharing min_shared entities; lone decisions are left out."""
    from .integrity import components

    p = settled(shared_entity_pairs(involves, min_shared).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    linked = p.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return components(linked, p).join(decisions.select("id"), "id", "left_semi")


def session_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session, n, roles, entities): each session's messages in order of time, entity names decoded from JSON."""
    m = messages.join(sessions.select("session"), "session", "left_semi").withColumn("names", F.from_json("extracted_entities", "array<string>"))
    g = m.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "role", "names"))).alias("rows"))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(r["names"], F.array().cast("array<string>"))))))
    return g.select("session", F.size("rows").alias("n"), F.transform("rows", lambda r: r["role"]).alias("roles"), names.alias("entities"))


def recorded_context(new: DataFrame, edges: DataFrame, entities: DataFrame, k: int = 5) -> DataFrame:
    """(id, entity_names, similar, supersedes, contradicts) of new decisions; similar are the k best SIMILAR_TO."""
    details = node_details(new, entities, edges)
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), "dst")
    best = of(edges, "SIMILAR_TO").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    similar = best.groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "dst"))), lambda x: x["dst"]).alias("similar"))
    return details.join(similar, "id", "left")


def entity_context(names: DataFrame, entities: DataFrame, involves: DataFrame, decisions: DataFrame, supersedes: DataFrame, k: int = 20) -> DataFrame:
    """(name, decisions, current, status, related): per asked name its decisions, and the k names that share most decisions with it."""
    hit = names.select("name", fold("name").alias("key")).distinct().join(name_keys(entities), "key").groupBy(F.col("id").alias("dst")).agg(F.collect_set("name").alias("asked"))
    own = entities.groupBy(F.col("id").alias("dst")).agg(F.collect_set("name").alias("others")).join(hit, "dst", "left")
    i = settled(involves.select("src", "dst"))
    parts = tasks_over(i)
    # a decision's names meet in its own row: pairs of names are counted, never listed by decision
    lists = i.repartition(parts, "dst").join(own.repartition(parts, "dst"), "dst").repartition(parts, "src").groupBy("src")
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    d = settled(lists.agg(all_of("asked"), all_of("others")).where(F.size("asked") > 0))
    cur = with_currency(decisions.select("id"), supersedes).withColumnRenamed("id", "src").repartition(parts, "src")
    base = d.select("src", "asked").repartition(parts, "src").join(cur, "src").select("src", F.explode("asked").alias("name"), "is_current")
    base = base.groupBy("name").agg(F.count(F.lit(1)).alias("decisions"), F.count_if("is_current").alias("current"))
    base = base.withColumn("status", F.when(F.col("current") == F.col("decisions"), "active").when(F.col("current") > 0, "partially_superseded").otherwise("superseded"))
    other = d.select(F.explode("asked").alias("name"), "others").select("name", F.explode("others").alias("other"))
    n = other.groupBy("name", "other").agg(F.count(F.lit(1)).alias("n")).where(fold("other") != fold("name"))
    w = Window.partitionBy("name").orderBy(F.desc("n"), "other")
    top = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]).alias("related"))
    return base.join(top, "name", "left")

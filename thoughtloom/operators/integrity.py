"""Checks and repairs of the graph."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import fold
from ..functions.tables import settled, tasks_for
from .graph import ENTITY_RELS, of, symmetric, within
from .resolve import duplicate_pairs

#: Relationships that keep an entity when a project is removed.
PROJECT_LINKS = ["INVOLVES", "SIMILAR_TO", "INFLUENCED_BY", "SUPERSEDES", "CONTRADICTS"]
CYCLIC = ["DEPENDS_ON", "REQUIRES", "PART_OF", "IS_A", "REFINES"]


def cyclic_core(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges (rel, src, dst) without those of dead ends: nodes without an edge in or out go, a few rounds of it."""
    e = settled(edges.where("src <> dst").select("rel", "src", "dst").distinct())
    for _ in range(rounds):
        into, out_of = e.select("rel", F.col("dst").alias("src")).distinct(), e.select("rel", F.col("src").alias("dst")).distinct()
        e = e.join(out_of, ["rel", "dst"], "left_semi").join(into, ["rel", "src"], "left_semi").select("rel", "src", "dst")
    return settled(e)


def _reach_labels(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(rel, id, f, b): of all nodes that reach a node, and of all that it reaches, those first in the order of hashes.

    In a round a node takes the first label of its neighbours and then the label that this label's own node has, which
    reaches it as well; so distances halve.
    """
    nodes = edges.select("rel", F.explode(F.array("src", "dst")).alias("id")).distinct()
    label = F.struct(F.xxhash64("id").alias("h"), F.col("id"))
    now = settled(nodes.select("rel", "id", label.alias("f"), label.alias("b")))
    for _ in range(rounds):
        ends = lambda mine, other, name: now.select("rel", F.col("id").alias(other), F.col(name).alias("x")).join(edges, ["rel", other]).select("rel", F.col(mine).alias("id"), F.col("x").alias(name))
        told = ends("dst", "src", "f").unionByName(ends("src", "dst", "b"), allowMissingColumns=True)
        told = told.unionByName(now.select("rel", "id", "f", "b", F.col("f").alias("old_f"), F.col("b").alias("old_b")), allowMissingColumns=True)
        told = settled(told.groupBy("rel", "id").agg(*[F.min(c).alias(c) for c in ("f", "b", "old_f", "old_b")]))
        of = lambda name: told.select("rel", F.col("id").alias(f"{name}_id"), F.col(name).alias(f"{name}_next"))
        hop = told.withColumns({"f_id": F.col("f.id"), "b_id": F.col("b.id")}).join(of("f"), ["rel", "f_id"]).join(of("b"), ["rel", "b_id"])
        new = settled(hop.select("rel", "id", F.least("f", "f_next").alias("f"), F.least("b", "b_next").alias("b"), "old_f", "old_b"))
        now = new.select("rel", "id", "f", "b")
        if new.where("f <> old_f OR b <> old_b").isEmpty():
            return now
    raise RuntimeError("labels did not settle")


def strong_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Edges (rel, src, dst, component) inside strongly connected components of a rel.

    An edge stays while both its ends have the same first node before them and the same first node after them. Where
    no edge goes any more, the first node of a piece reaches all of it and is reached by all of it.
    """
    e = cyclic_core(edges)
    n = e.count()
    for _ in range(rounds):
        if not n:
            return e.withColumn("component", F.col("src"))
        labels = _reach_labels(e)
        end = lambda c: labels.select("rel", F.col("id").alias(c), F.struct("f", "b").alias(f"{c}_label"))
        e = settled(e.join(end("src"), ["rel", "src"]).join(end("dst"), ["rel", "dst"]).where("src_label = dst_label").select("rel", "src", "dst", F.col("src_label.f.id").alias("component")))
        m = e.count()
        if m == n:
            return e
        n, e = m, e.select("rel", "src", "dst")
    raise RuntimeError("components did not settle")


def cycles_of(pairs: list[tuple], max_depth: int) -> list[tuple]:
    """Simple cycles of 2 to max_depth of a few edges, each set of nodes once, from its least node on."""
    to: dict = {}
    for a, b in pairs:
        to.setdefault(a, []).append(b)
    best: dict = {}
    for first in to:
        open_ = [(first,)]
        while open_:
            path = open_.pop()
            for b in to.get(path[-1], ()):
                if b == first:
                    nodes = frozenset(path)
                    best[nodes] = min(best.get(nodes, path), path)
                elif b > first and len(path) < max_depth and b not in path:
                    open_.append((*path, b))
    return list(best.values())


def _cycles_of_small(edges: DataFrame, max_depth: int, small: int) -> tuple[DataFrame, DataFrame]:
    """(cycles, rest): cycles of the connected components of up to `small` edges, found inside tasks; rest: the edges of greater ones."""
    e = settled(edges.where("src <> dst").select("rel", "src", "dst").distinct())
    label = connected(e, ["rel"]).select("rel", F.col("id").alias("src"), "c")
    e = settled(e.join(label, ["rel", "src"]).select("rel", "c", "src", "dst"))
    great = settled(e.groupBy("rel", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("rel", "c"))
    own = e.join(great, ["rel", "c"], "left_anti").groupBy("rel", "c").agg(F.collect_list(F.struct("src", "dst")).alias("x")).select("rel", "x.src", "x.dst")
    kinds = {f.name: f.dataType for f in e.schema}
    schema = T.StructType([T.StructField("rel", kinds["rel"]), T.StructField("nodes", T.ArrayType(kinds["src"])), T.StructField("length", T.IntegerType())])

    def run(batches):
        for b in batches:
            out = [(rel, list(nodes), len(nodes)) for rel, src, dst in zip(*(b.column(i).to_pylist() for i in range(3))) for nodes in cycles_of(zip(src, dst), max_depth)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((b.schema.field(0).type, b.schema.field(1).type, pa.int32()))], names=["rel", "nodes", "length"])

    return settled(own.mapInArrow(run, schema)), settled(e.join(great, ["rel", "c"], "left_semi").select("rel", "src", "dst"))


def find_cycles(edges: DataFrame, max_depth: int = 20, most: int | None = 10, small: int = 40) -> DataFrame:
    """(rel, nodes, length) of simple cycles of 2 to max_depth edges of one rel, each set of nodes once, from its least node on.

    Edges without a column rel count as one rel. `most` is the size of the report: the shortest cycles of each rel, the
    least nodes of equals; a rel is walked only until it has them, so a dense graph is not walked to its end. None
    reports all, whose number can grow as the branching to the power of the depth. Walks start at every node and visit
    greater nodes only, so a cycle is met once in each direction that it has; beyond three edges they stay in a strongly
    connected component.
    With each step of the walks, the nodes from which a start can be reached are extended by a step backwards, too; as
    soon as these distances cover what is left of the depth, walks that cannot return in time end.
    Where all cycles of more than three edges are asked for, connected components of up to `small` edges (few enough to
    bound their cycles) are searched each inside one task, and only greater ones are walked.
    """
    edges = edges if "rel" in edges.columns else edges.withColumn("rel", F.lit(""))
    found = None
    if most is None and max_depth > 3:
        found, edges = _cycles_of_small(edges, max_depth, small)
        if edges.isEmpty():
            return found
    core = cyclic_core(edges)
    step = core.select("rel", F.col("src").alias("at"), F.col("dst").alias("to"))
    walk = core.where("dst > src").select("rel", F.col("src").alias("first"), F.col("dst").alias("at"), F.array("src", "dst").alias("nodes"))
    back = core.where("src > dst").select("rel", F.col("dst").alias("first"), F.col("src").alias("at"), F.lit(1).alias("home"))
    homes = newest = settled(back)
    first_of = Window.partitionBy("rel").orderBy("nodes")
    have = {}  # cycles of a relationship so far
    for length in range(2, max_depth + 1):
        closed = walk.join(step, ["rel", "at"]).where("to = first").groupBy("rel", F.array_sort("nodes").alias("members")).agg(F.min("nodes").alias("nodes"))
        closed = closed.select("rel", "nodes", F.lit(length).alias("length"))
        if most is not None:
            # shorter cycles go first, so a length adds what the lengths before it left open
            left = F.lit(most)
            for rel, n in have.items():
                left = F.when(F.col("rel") == rel, F.lit(most - n)).otherwise(left)
            closed = closed.withColumn("r", F.row_number().over(first_of)).where(F.col("r") <= left).drop("r")
        closed = settled(closed)
        found = closed if found is None else found.unionByName(closed)
        if length == max_depth:
            break
        if most is not None:
            for r in closed.groupBy("rel").count().collect():  # one row a relationship
                have[r.rel] = have.get(r.rel, 0) + r["count"]
            full = [rel for rel, n in have.items() if n >= most]
            walk = walk.where(~F.col("rel").isin(full)) if full else walk
        if length == 3:
            # so far no walk has more than two open edges; from here on only components are walked
            of = settled(strong_components(core).select("rel", F.col("src").alias("id"), "component").distinct())
            inside = lambda df, a, b: df.join(of.toDF("rel", a, "_a"), ["rel", a]).join(of.toDF("rel", b, "_b"), ["rel", b]).where("_a = _b").select(*df.columns)
            step, walk, homes, newest = settled(inside(step, "at", "to")), inside(walk, "first", "at"), settled(inside(homes, "first", "at")), inside(newest, "first", "at")
        longer = walk.join(step, ["rel", "at"]).where("to > first").where(~F.array_contains("nodes", F.col("to")))
        longer = longer.select("rel", "first", F.col("to").alias("at"), F.array_append("nodes", F.col("to")).alias("nodes"))
        # `length` edges are walked after this step, and max_depth - length may follow
        if length <= max_depth - length:
            wider = newest.join(step.select("rel", F.col("to").alias("at"), F.col("at").alias("from")), ["rel", "at"]).where("from > first")
            wider = wider.select("rel", "first", F.col("from").alias("at"), F.lit(length).alias("home")).distinct().join(homes.select("rel", "first", "at"), ["rel", "first", "at"], "left_anti")
            newest = settled(wider.join(walk.select("rel", "first").distinct(), ["rel", "first"], "left_semi"))
            homes = homes.unionByName(newest)
        else:
            longer = longer.join(homes.where(F.col("home") <= max_depth - length).select("rel", "first", "at"), ["rel", "first", "at"], "left_semi")
        walk = settled(longer)
        if walk.isEmpty():
            break
    return found


def dependency_paths(pairs: DataFrame, edges: DataFrame, max_depth: int = 20) -> DataFrame:
    """(src, dst, length, path): a shortest path for each reachable pair, the least of equals; breadth first with settled frontiers."""
    goals = settled(pairs.select("src", "dst").distinct())
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    front = settled(goals.select("src", F.col("src").alias("at"), F.array("src").alias("path")).distinct())
    seen, found = front.select("src", "at"), None
    for depth in range(1, max_depth + 1):
        new = front.join(step, "at").select("src", F.col("to").alias("at"), F.array_append("path", F.col("to")).alias("path")).join(seen, ["src", "at"], "left_anti")
        front = settled(new.groupBy("src", "at").agg(F.min("path").alias("path")))
        if front.limit(1).count() == 0:
            break
        hit = front.join(goals.select("src", F.col("dst").alias("at")), ["src", "at"]).select("src", F.col("at").alias("dst"), F.lit(depth).alias("length"), "path")
        found = hit if found is None else found.unionByName(hit)
        seen = seen.unionByName(front.select("src", "at"))
    if found is None:
        return goals.select("src", "dst", F.lit(0).alias("length"), F.array("src").alias("path")).limit(0)
    return found


def orphan_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    linked = of(edges, "INVOLVES").select(F.col("dst").alias("id"))
    ends = symmetric(of(edges, *ENTITY_RELS)).select("id")
    return entities.join(linked, "id", "left_semi").join(ends, "id", "left_anti")


def low_confidence_edges(decisions: DataFrame, edges: DataFrame, t: float = 0.5, k: int | None = 50) -> DataFrame:
    e = edges.where(F.col("confidence") < t).join(decisions.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "rel", "confidence")
    return e if k is None else e.orderBy("confidence", "src", "dst").limit(k)


def missing_embeddings(rows: DataFrame) -> DataFrame:
    """(kind, missing) of a table (kind, id, embedding)."""
    return rows.groupBy("kind").agg(F.count_if(F.col("embedding").isNull()).alias("missing")).where("missing > 0")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def wrong_level_edges(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """Entity relationships (all but RELATED_TO) between two decisions."""
    ids = decisions.select("id")
    e = of(edges, *[r for r in ENTITY_RELS if r != "RELATED_TO"])
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def auto_fix(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def issues(kind: str, severity: str | Column, rows: DataFrame, nodes: Column, message: str) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(F.lit(kind).alias("type"), level.alias("severity"), F.lit(message).alias("message"), nodes.cast("array<bigint>").alias("nodes"))


def validate_all(decisions: DataFrame, entities: DataFrame, edges: DataFrame, aliases: DataFrame | None = None, vectors: DataFrame | None = None, max_depth: int = 20) -> DataFrame:
    """All issues (type, severity, message, nodes) as one table.

    Duplicate names stand as the least id of each; missing embeddings are one issue a kind, of a table vectors
    (kind, id, embedding) where it is given.
    """
    out = issues("circular_dependency", "ERROR", find_cycles(of(edges, *CYCLIC), max_depth), F.col("nodes"), "cycle")
    out = out.unionByName(issues("orphan_entity", "WARNING", orphan_entities(entities, edges), F.array("id"), "no relation to another entity"))
    out = out.unionByName(issues("low_confidence", "INFO", low_confidence_edges(decisions, edges), F.array("src", "dst"), "low confidence"))
    first = entities.groupBy(fold("name").alias("name")).agg(F.min("id").alias("id"))
    pairs = duplicate_pairs(entities, aliases).join(first.toDF("a", "ia"), "a").join(first.toDF("b", "ib"), "b")
    out = out.unionByName(issues("duplicate_entity", F.col("severity"), pairs, F.array("ia", "ib"), "similar names"))
    if vectors is not None:
        out = out.unionByName(issues("missing_embedding", F.when(F.col("kind") == "decision", "WARNING").otherwise("INFO"), missing_embeddings(vectors), F.array(), "rows without an embedding"))
    out = out.unionByName(issues("self_loop", "ERROR", self_loops(edges), F.array("src"), "edge to itself"))
    return out.unionByName(issues("invalid_relationship", "ERROR", wrong_level_edges(decisions, edges), F.array("src", "dst"), "entity relation between decisions"))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """A settled table of edges without those of the decisions `gone` (settled), in tasks of a bounded number of edges."""
    parts = tasks_for(edges)
    rest = edges.where(~F.col("rel").isin(ENTITY_RELS)).repartition(parts, "src").join(gone.select(F.col("id").alias("src")), "src", "left_anti")
    between = rest.where("rel <> 'INVOLVES'").repartition(parts, "dst").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return of(rest, "INVOLVES").unionByName(between.select(*rest.columns))


def delete_where(decisions: DataFrame, entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, entities, edges) without the decisions `gone` (id), their edges, and entities that nothing involves any more."""
    g, every = settled(gone.select("id").distinct()), settled(edges)
    e = of(every, *ENTITY_RELS).unionByName(_without(every, g).select(*every.columns))
    kept = entities.join(of(e, "INVOLVES").select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    return decisions.join(g, "id", "left_anti"), kept, e


def delete_project(decisions: DataFrame, entities: DataFrame, edges: DataFrame, project: str, linked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, entities, edges) without the decisions of a project, of all tenants, and all their edges.

    Entities go with theirs that no edge of PROJECT_LINKS has any more: INVOLVES among edges, and `linked` (id) where
    others of these join entities.
    """
    gone = settled(decisions.where(F.col("project_name") == project).select("id").distinct())
    every = settled(edges)
    rest = settled(_without(every, gone))
    still = of(rest, "INVOLVES").select(F.col("dst").alias("id"))
    kept = entities.join((still if linked is None else still.union(linked.select("id"))).distinct(), "id", "left_semi")
    between = within(of(every, *ENTITY_RELS), settled(kept.select("id").distinct()), "src", "dst")
    return decisions.join(gone, "id", "left_anti"), kept, rest.select(*edges.columns).unionByName(between.select(*edges.columns))


def delete_entities(ids: DataFrame, entities: DataFrame, involves: DataFrame, decisions: DataFrame, user_id: int, force: bool = False) -> DataFrame:
    """(id, outcome): not_found, blocked_other_tenant, blocked_linked or deleted."""
    own = F.col("user_id") == user_id
    links = involves.join(decisions.select(F.col("id").alias("src"), "user_id"), "src").groupBy(F.col("dst").alias("id")).agg(F.count_if(own).alias("mine"), F.count_if(~own).alias("others"))
    x = ids.select("id").distinct().join(entities.select("id", F.lit(True).alias("known")), "id", "left").join(links, "id", "left")
    outcome = F.when(F.col("known").isNull(), "not_found").when(F.coalesce("others", F.lit(0)) > 0, "blocked_other_tenant").when((F.coalesce("mine", F.lit(0)) > 0) & F.lit(not force), "blocked_linked").otherwise("deleted")
    return x.select("id", outcome.alias("outcome"))


def connected(edges: DataFrame, by: list[str] | None = None, rounds: int = 60) -> DataFrame:
    """(by, id, c): a node of its connected component for every node of edges (by, src, dst); components of one `by` each.

    In a round each node joins that of its neighbours and itself which comes first in the order of hashes; the edges are
    then those between the joined nodes, and about half of these are left each time, so all rounds together move little
    more than the first one does. Afterwards the rounds are followed back, the smallest first.
    """
    by = by or []
    e = settled(edges.where("src <> dst").select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if e.isEmpty():
            break
        both = e.select(*by, F.col("a").alias("id"), F.col("b").alias("other")).unionByName(e.select(*by, F.col("b").alias("id"), F.col("a").alias("other")))
        first = both.groupBy(*by, "id").agg(F.min(F.struct(F.xxhash64("other").alias("h"), F.col("other"))).alias("x"))
        to = F.when(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("other")) < F.col("x"), F.col("id")).otherwise(F.col("x.other"))
        now = settled(first.select(*by, "id", to.alias("to")))
        maps.append(now)
        end = lambda c: now.select(*by, F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        moved = e.join(end("a"), [*by, "a"]).join(end("b"), [*by, "b"]).where("a_to <> b_to")
        e = settled(moved.select(*by, F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return e.select(*by, F.col("a").alias("id"), F.col("b").alias("c"))
    label = maps.pop().withColumnRenamed("to", "c")
    for now in reversed(maps):
        label = settled(now.join(label.withColumnRenamed("id", "to"), [*by, "to"], "left").select(*by, "id", F.coalesce("c", "to").alias("c")))
    return label


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): least id reachable."""
    label = connected(edges, rounds=rounds)
    least = label.groupBy("c").agg(F.min("id").alias("component"))
    own = label.join(least, "c").select("id", "component")
    return nodes.select("id").distinct().join(own, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy("id").agg(F.countDistinct("other").alias("degree"))


def parallel_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, rel, index, size): place of an edge among those between the same two nodes."""
    pair = [F.least("src", "dst"), F.greatest("src", "dst")]
    w = Window.partitionBy(*pair)
    return edges.select("src", "dst", "rel", F.row_number().over(w.orderBy("rel", "src")).alias("index"), F.count(F.lit(1)).over(w).alias("size"))

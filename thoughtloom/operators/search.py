"""Vector, full-text and hybrid search for tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import filled
from ..functions.tables import settled
from .text_index import TextIndex, postings, rank
from .vectors import similar


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, over the shorter's length; 0 for empty or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(0.0)


def link_similar(vectors: DataFrame, threshold: float = 0.85, high: float = 0.90, k: int = 5, by: str | None = None) -> DataFrame:
    """(query, id, score, tier): the k best of each row over the threshold; by: among rows of one value (a tenant's) only."""
    return similar(vectors, vectors, k, threshold, by=by).withColumn("tier", F.when(F.col("score") >= high, "high").otherwise("moderate"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score): the k best documents (id, text) of each query (id, text) by BM25 over its distinct terms."""
    return rank(queries, postings(docs.select("id", "text"), ["text"]), k, k1, b).select("query", "id", "score")


def fulltext_search(queries: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """BM25; a query without any hit falls back to case-insensitive substrings with score 1, newest (greatest) ids first."""
    hits = settled(bm25(queries, docs, k))
    return hits.unionByName(substring_hits(queries, docs, hits, k))


def substring_hits(queries: DataFrame, docs: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(query, id, score 1): texts that hold a query which has no hit; the k greatest ids."""
    rest = queries.join(hits.select(F.col("query").alias("id")), "id", "left_anti").where(F.length("text") > 0)
    asked = rest.select(F.col("id").alias("query"), F.lower("text").alias("q"))
    # a text that holds the query holds its first three characters; shorter queries meet it through as many
    grams = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("t") - n + 1)), lambda i: F.substring("t", i, n)))))
    asked = settled(asked.withColumn("g", F.substring("q", 1, 3)))
    texts = docs.select("id", F.lower("text").alias("t")).withColumn("g", F.explode(grams))
    sub = texts.join(asked, "g").where(F.contains("t", "q")).select("query", "id", F.lit(1.0).alias("score")).distinct()
    w = Window.partitionBy("query").orderBy(F.desc("id"))
    return sub.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def search_kinds(queries: DataFrame, decisions: TextIndex, entities: TextIndex, k: int = 20) -> DataFrame:
    """(query, kind, id, score): the k best decisions and the k best entities of each query, each kind with its own fallback."""
    out = None
    for kind, index in (("decision", decisions), ("entity", entities)):
        hits = settled(rank(queries, index.read(), k).select("query", "id", "score"))
        found = hits.unionByName(substring_hits(queries, index.texts(), hits, k)).select("query", F.lit(kind).alias("kind"), "id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def suggest(queries: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """(query, name, place): names that start with the query, then those that hold it, by name."""
    q, n = F.lower("query"), F.lower("name")
    # a name that holds the query holds its first three characters: grams make the join an equi-join
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(c, i, F.lit(3))))
    left = queries.where(F.length("query") >= 3).select("query", F.substring(q, 1, 3).alias("g"))
    hit = names.select("name").distinct().withColumn("g", F.explode(grams(n))).join(left, "g").where(F.contains(n, q)).select("query", "name")
    w = Window.partitionBy("query").orderBy((~F.startswith(F.lower("name"), F.lower("query"))).cast("int"), "name")
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def hybrid(lexical: DataFrame, semantic: DataFrame, alpha: float = 0.3, threshold: float = 0.0, k: int = 10) -> DataFrame:
    """(query, id, lex, sem, combined) of two result tables (query, id, score); a missing side counts 0."""
    a = lexical.select("query", "id", F.least(F.col("score") / 10, F.lit(1.0)).alias("lex"))
    b = semantic.select("query", "id", F.col("score").alias("sem"))
    j = a.join(b, ["query", "id"], "full_outer").select("query", "id", F.coalesce("lex", F.lit(0.0)).alias("lex"), F.coalesce("sem", F.lit(0.0)).alias("sem"))
    j = j.withColumn("combined", alpha * F.col("lex") + (1 - alpha) * F.col("sem")).where(F.col("combined") >= threshold)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("combined", 9)), "id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand_hits(hits: DataFrame, edges: DataFrame, depth: int = 1, decay: float = 0.7, per_hit: int = 10) -> DataFrame:
    """(query, id, score) of nodes within `depth` of a hit, decay * the hit's score, at most per_hit for each hit, hits left out."""
    from .graph import symmetric

    step = symmetric(edges).select(F.col("id").alias("at"), F.col("other").alias("to")).distinct()
    front = hits.select("query", F.col("id").alias("hit"), F.col("id").alias("at"), "score")
    found = None
    for _ in range(depth):
        front = front.join(step, "at").select("query", "hit", F.col("to").alias("at"), "score").distinct()
        found = front if found is None else found.unionByName(front)
    found = found.join(hits.select("query", F.col("id").alias("at")), ["query", "at"], "left_anti")
    w = Window.partitionBy("query", "hit").orderBy("at")
    found = found.select("query", "hit", "at", "score").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_hit)
    return found.groupBy("query", F.col("at").alias("id")).agg((decay * F.max("score")).alias("score"))


def rerank_fuse(results: DataFrame, scores: DataFrame, top: int = 20, weight: float = 0.7) -> DataFrame:
    """combined of the first `top` results of a query mixed with a supplied score."""
    r = results.join(scores.select("query", "id", F.col("score").alias("_given")), ["query", "id"], "left")
    mixed = F.when((F.col("rank") <= top) & F.col("_given").isNotNull(), weight * F.col("_given") + (1 - weight) * F.col("combined")).otherwise(F.col("combined"))
    return r.withColumn("final", mixed).drop("_given")


def prior_art(similar_: DataFrame, abandoned: DataFrame, contradictions: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id, top, recommendation) of proposals from their similar decisions, abandoned patterns and contradictions."""
    top = similar_.groupBy(F.col("query").alias("id")).agg(F.max("score").alias("top"))
    has = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
    p = proposals.select("id").join(top, "id", "left").join(has(abandoned, "gone"), "id", "left").join(has(contradictions, "against"), "id", "left")
    advice = F.when(F.col("against"), "resolve_contradiction").when(F.col("top") > 0.8, "review_similar").when(F.col("gone"), "review_similar").otherwise("proceed")
    return p.select("id", "top", advice.alias("recommendation"))


def sort_results(df: DataFrame, by: str) -> DataFrame:
    return df.orderBy({"relevance": F.desc("combined"), "date": F.desc("created_at"), "confidence": F.desc("confidence")}[by], "id")


def embedding_text(decisions: DataFrame) -> DataFrame:
    """(id, text): labelled fields on lines, absent ones left out."""
    fields = [("Trigger", "trigger"), ("Context", "context"), ("Decision", "agent_decision"), ("Rationale", "agent_rationale")]
    return decisions.select("id", F.concat_ws("\n", *[F.when(filled(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(c))) for n, c in fields]).alias("text"))


def embedding_worklist(rows: DataFrame) -> DataFrame:
    """(hash, text, n) of rows (id, text, embedding) without a vector, one for each text."""
    need = rows.where("embedding IS NULL").select(F.sha2("text", 256).alias("hash"), "text")
    return need.groupBy("hash").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"))


def context_markdown(decisions: DataFrame) -> DataFrame:
    """(query, text): a line for each decision (query, place, trigger, agent_decision, is_current), in order."""
    line = F.concat(F.lit("- ["), F.when(F.col("is_current"), "CURRENT").otherwise("SUPERSEDED"), F.lit("] "), F.col("trigger"), F.lit(": "), F.coalesce("agent_decision", F.lit("(not recorded)")))
    return decisions.groupBy("query").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def context_pack(lexical: DataFrame, semantic: DataFrame, decisions: DataFrame, supersedes: DataFrame, n: int = 10, budget: int = 2000) -> DataFrame:
    """(query, id, place, combined, is_current, spent): .3 lexical + .7 semantic, the n best, cut where their texts exceed the token budget."""
    from .graph import with_currency
    from .rules import within_budget

    best = hybrid(lexical, semantic, 0.3, 0.0, n)
    # lengths are joined, not the texts
    chars = F.length(F.concat_ws(" ", "trigger", "context", "agent_decision", "agent_rationale"))
    d = with_currency(decisions.select("id", chars.alias("chars")), supersedes)
    return within_budget(best.join(d, "id"), ["query"], [F.col("rank")], F.col("chars"), budget).select("query", "id", F.col("rank").alias("place"), "combined", "is_current", "spent")


def pack_entities(pack: DataFrame, involves: DataFrame, entities: DataFrame, edges: DataFrame, most: int = 30, related: int = 5) -> DataFrame:
    """(query, place, id, name, type, decisions, related): the entities that most decisions of a pack (query, id) involve, with names of neighbours."""
    from .graph import of, related_entities

    n = pack.select("query", F.col("id").alias("src")).distinct().join(involves.select("src", F.col("dst").alias("id")).distinct(), "src").groupBy("query", "id").agg(F.count(F.lit(1)).alias("decisions"))
    w = Window.partitionBy("query").orderBy(F.desc("decisions"), "name", "id")
    top = settled(n.join(entities.select("id", "name", "type"), "id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most))
    near = related_entities(entities, of(edges, "RELATED_TO", "IS_A", "PART_OF", "DEPENDS_ON"), related).join(top.select("id").distinct(), "id", "left_semi")
    return top.join(near, "id", "left").select("query", "place", "id", "name", "type", "decisions", F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def pack_chains(pack: DataFrame, supersedes: DataFrame, contradicts: DataFrame, hops: int = 3, most: int = 5) -> DataFrame:
    """(query, kind, place, path): per pack the shortest supersession paths that start or end in it, and its contradicting pairs."""
    from .graph import supersession_chains, symmetric

    ids = settled(pack.select("query", "id").distinct())
    paths = lambda edges: supersession_chains(edges, ids.select("id"), hops, None).select(F.col("start").alias("id"), "path")
    older, newer = paths(supersedes), paths(supersedes.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = older.unionByName(newer.withColumn("path", F.reverse("path"))).withColumn("kind", F.lit("supersedes"))
    against = symmetric(contradicts.select("src", "dst")).select("id", F.array(F.least("id", "other"), F.greatest("id", "other")).alias("path"), F.lit("contradicts").alias("kind"))
    found = ids.join(found.unionByName(against), "id").select("query", "kind", "path").distinct()
    w = Window.partitionBy("query", "kind").orderBy(F.size("path"), "path")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)

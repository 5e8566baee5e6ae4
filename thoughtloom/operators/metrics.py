"""Counts and shares over decisions, entities and files. `as_of` stands for now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import days_between, half_even, period, slug
from ..functions.tables import settled, tasks_over
from .graph import with_currency


def timeline(decisions: DataFrame, granularity: str, months_back: int, as_of: Column) -> DataFrame:
    """(period, key, n, avg_confidence): key NULL is the total of the period, else scope:x or type:x."""
    d = decisions.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(30 * months_back))).withColumn("period", period("created_at", granularity))
    keys = [F.lit(None).cast("string"), F.concat(F.lit("scope:"), F.coalesce("scope", F.lit("unknown")))]
    if "decision_type" in decisions.columns:
        keys.append(F.concat(F.lit("type:"), F.coalesce("decision_type", F.lit("general"))))
    return d.withColumn("key", F.explode(F.array(*keys))).groupBy("period", "key").agg(F.count(F.lit(1)).alias("n"), half_even(F.avg("confidence"), 3).alias("avg_confidence"))


def coverage(files: DataFrame, decisions: DataFrame, affects: DataFrame, as_of: Column, stale_days: int = 90) -> DataFrame:
    """(file, decisions, days_since, is_stale) of every file, covered or not."""
    pairs = settled(affects.select("src", "dst").distinct())
    parts = tasks_over(pairs)
    # pairs and decisions are told apart before they meet, so nothing is counted by pair after it
    made = decisions.select(F.col("id").alias("src"), "created_at").repartition(parts, "src").groupBy("src").agg(F.max("created_at").alias("created_at"))
    per = pairs.repartition(parts, "src").join(made, "src").groupBy(F.col("dst").alias("file")).agg(F.count(F.lit(1)).alias("decisions"), F.max("created_at").alias("latest"))
    out = files.select("file").join(per, "file", "left").withColumn("days_since", days_between(as_of, F.col("latest")))
    return out.select("file", F.coalesce("decisions", F.lit(0)).alias("decisions"), "days_since", F.coalesce(F.col("days_since") > stale_days, F.lit(False)).alias("is_stale"))


def coverage_stats(detail: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    bare = F.count_if(F.col("decisions") == 0)
    return detail.agg(n.alias("files"), F.count_if(F.col("decisions") > 0).alias("covered"), bare.alias("uncovered"), F.count_if("is_stale").alias("stale"), half_even(bare / F.greatest(n, F.lit(1)), 3).alias("debt"))


def dashboard_stats(decisions: DataFrame, entities: DataFrame, sessions: DataFrame) -> DataFrame:
    d = decisions.agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("human_rationale").isNull()).alias("needs_review"))
    return d.crossJoin(entities.agg(F.count(F.lit(1)).alias("entities"))).crossJoin(sessions.agg(F.countDistinct("conv_id").alias("sessions")))


def newest(decisions: DataFrame, k: int = 6) -> DataFrame:
    return decisions.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def graph_stats(decisions: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: decisions, entities that a decision involves, and edges that leave decisions."""
    out = edges.join(decisions.select(F.col("id").alias("src")), "src", "left_semi").where(F.col("rel").isin("INVOLVES", "SUPERSEDES", "CONTRADICTS", "SIMILAR_TO", "INFLUENCED_BY", "FOLLOWS", "PRECEDES"))
    e = out.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct(F.when(F.col("rel") == "INVOLVES", F.col("dst"))).alias("linked_entities"))
    return decisions.agg(F.count(F.lit(1)).alias("decisions")).crossJoin(e)


def rel_counts(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(decisions.select(F.col("id").alias("src")), "src", "left_semi").groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def source_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def project_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(F.coalesce("project_name", F.lit("unassigned")).alias("project_name")).agg(F.count(F.lit(1)).alias("n"))


def project_list(decisions: DataFrame) -> DataFrame:
    return decisions.where("project_name IS NOT NULL").groupBy("project_name").agg(F.min("created_at").alias("first_at"), F.count(F.lit(1)).alias("n"))


def project_stats(decisions: DataFrame, involves: DataFrame) -> DataFrame:
    base = decisions.where("project_name IS NOT NULL")
    d = base.groupBy("project_name").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    e = involves.join(base.select(F.col("id").alias("src"), "project_name"), "src").groupBy("project_name").agg(F.countDistinct("dst").alias("entities"))
    return d.join(e, "project_name", "left").withColumn("entities", F.coalesce("entities", F.lit(0)))


def entity_degree(involves: DataFrame) -> DataFrame:
    return involves.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("decisions"))


def top_entities(entities: DataFrame, involves: DataFrame, k: int = 15) -> DataFrame:
    return entity_degree(involves).join(entities.select("id", "name", "type"), "id").orderBy(F.desc("decisions"), "id").limit(k)


def top_decisions(decisions: DataFrame, involves: DataFrame, supersedes: DataFrame, k: int = 10) -> DataFrame:
    n = involves.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n"))
    score = 0.4 * F.coalesce("confidence", F.lit(0.0)) + 0.3 * F.coalesce("n", F.lit(0)) / 10 + F.when(F.col("created_at").isNotNull(), 0.3).otherwise(0.0)
    top = decisions.join(n, "id", "left").select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return with_currency(top, supersedes)


def knowledge_gaps(decisions: DataFrame, entities: DataFrame, involves: DataFrame, few: int = 2, low: float = 0.6, k: int = 10) -> DataFrame:
    """Entity types with few distinct decisions or a low mean confidence over edges."""
    j = involves.join(entities.select(F.col("id").alias("dst"), "type"), "dst").join(decisions.select(F.col("id").alias("src"), "confidence"), "src")
    g = j.groupBy("type").agg(F.countDistinct("src").alias("decisions"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    return g.where((F.col("decisions") <= few) | (F.col("avg_confidence") < low)).orderBy("decisions", "type").limit(k)


def daily_activity(decisions: DataFrame, as_of: Column, days: int = 30, keep: int = 14) -> DataFrame:
    """(day, n) of the last `keep` days, zero-filled."""
    today = F.to_date(as_of)
    calendar = decisions.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, keep - 1), today)).alias("day"))
    n = decisions.where(F.col("created_at") >= F.date_sub(today, days - 1)).groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def entity_type_distribution(entities: DataFrame, involves: DataFrame) -> DataFrame:
    pairs = involves.select("src", "dst").distinct().join(entities.select(F.col("id").alias("dst"), "type"), "dst", "left")
    return pairs.groupBy(F.coalesce("type", F.lit("other")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def confidence_histogram(decisions: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, n) with bin 0 for [0, 1/bins); 1 and values out of range fall into the last bin."""
    c = F.col("confidence")
    b = F.when((c < 0) | (c >= 1), bins - 1).otherwise(F.floor(c * bins)).cast("int")
    n = decisions.where(c.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return decisions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def quick_stats(decisions: DataFrame, involves: DataFrame, as_of: Column) -> DataFrame:
    d = decisions.agg(F.round(100 * F.avg("confidence"), 0).alias("confidence_percent"), F.count_if(F.col("created_at") >= as_of - F.expr("INTERVAL 7 DAYS")).alias("last_week"), F.count(F.lit(1)).alias("_n"))
    e = involves.agg(F.countDistinct("dst").alias("entities"), F.count(F.lit(1)).alias("_pairs"))
    return d.crossJoin(e).select("confidence_percent", "last_week", "entities", F.round(F.col("_pairs") / F.greatest("_n", F.lit(1)), 1).alias("entities_per_decision"))


def month_groups(decisions: DataFrame) -> DataFrame:
    """(month, n, newest): ids newest first would grow with the month, so the group keeps its count and its newest id."""
    return decisions.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("created_at", "id"))["id"].alias("newest"))


def month_order(decisions: DataFrame) -> DataFrame:
    """Each decision with its month and its place in it, newest first."""
    month = F.date_format("created_at", "yyyy-MM")
    return decisions.select("id", month.alias("month"), F.row_number().over(Window.partitionBy(month).orderBy(F.desc("created_at"), F.desc("id"))).alias("place"))


def dormant_tiers(dormant: DataFrame) -> DataFrame:
    tier = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low")
    return dormant.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.max("days").alias("longest_days"))


def mine_aliases(entities: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(slug, canonical, n): names that differ but share letters and digits; canonical is the longest, then the first."""
    e = entities if types is None else entities.where(F.lower("type").isin(types))
    e = e.select(slug("name").alias("slug"), "name", F.lower("name").alias("low")).where(F.length("slug") > 2)
    g = e.groupBy("slug").agg(F.countDistinct("low").alias("n"), F.max(F.struct(F.length("name"), "name"))["name"].alias("canonical"))
    return g.where("n >= 2").select("slug", "canonical", "n")


def usage_rollup(calls: DataFrame, prompt_usd: float = 0.30, completion_usd: float = 2.50) -> DataFrame:
    """Per model: calls, tokens, cost in dollars (prices for a million tokens) and mean latency."""
    return calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round((F.sum("prompt_tokens") * prompt_usd + F.sum("completion_tokens") * completion_usd) / 1e6, 6).alias("cost_usd"),
        F.round(F.avg("latency"), 6).alias("avg_latency"),
    )


def resolution_summary(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("new"))


def extraction_summary(decisions: DataFrame, by: str = "user_id") -> DataFrame:
    r = lambda c: F.round(c, 6)
    return decisions.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("confidence")).alias("mean"), r(F.min("confidence")).alias("least"), r(F.max("confidence")).alias("most"),
        r(F.avg("raw_confidence")).alias("raw_mean"), r(F.avg(F.col("confidence") - F.col("raw_confidence"))).alias("delta"),
    )


def user_profile(users: DataFrame, decisions: DataFrame, sessions: DataFrame) -> DataFrame:
    d = decisions.groupBy("user_id").agg(F.count(F.lit(1)).alias("decisions"))
    s = sessions.groupBy("user_id").agg(F.countDistinct("session").alias("sessions"))
    return users.select("user_id").join(d, "user_id", "left").join(s, "user_id", "left").select("user_id", F.coalesce("decisions", F.lit(0)).alias("decisions"), F.coalesce("sessions", F.lit(0)).alias("sessions"))


def validation_summary(issues: DataFrame) -> DataFrame:
    """(kind, key, n): counts by severity, zero-filled, and by type."""
    spark = issues.sparkSession
    levels = spark.createDataFrame([("ERROR",), ("WARNING",), ("INFO",)], "key string")
    by = issues.groupBy(F.col("severity").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    sev = levels.join(by, "key", "left").select(F.lit("severity").alias("kind"), "key", F.coalesce("n", F.lit(0)).alias("n"))
    return sev.unionByName(issues.groupBy(F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("kind"), "key", "n"))


def import_progress(log: DataFrame) -> DataFrame:
    """Per job: files by status, decisions, errors, share done."""
    done = F.count_if(F.col("status") == "done")
    return log.groupBy("job").agg(F.count(F.lit(1)).alias("files"), done.alias("done"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("decisions").alias("decisions"), F.round(done / F.count(F.lit(1)), 6).alias("share"))


def entity_list(entities: DataFrame, involves: DataFrame, decisions: DataFrame, k: int = 100) -> DataFrame:
    from .graph import visible_entities

    return visible_entities(entities, involves, decisions).select("name").distinct().orderBy("name").limit(k)


def event_counters(events: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(labels, bin, n, total): bin is the number of bounds at or under the value."""
    b = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(value)))
    return events.groupBy(*labels, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))


def inbox(notifications: DataFrame, limit: int = 20, unread_only: bool = False) -> DataFrame:
    n = notifications.where(~F.col("read")) if unread_only else notifications
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def unread_counts(notifications: DataFrame, most: int = 200) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.least(F.lit(most), F.count_if(~F.col("read"))).alias("unread"))


def mark_read(notifications: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return notifications.join(hit, "id", "left").withColumn("read", F.col("read") | F.coalesce("_hit", F.lit(False))).drop("_hit")

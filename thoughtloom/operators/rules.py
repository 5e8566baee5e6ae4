"""Time rules, dormancy, budgets and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import days_between, find_all, fold, half_even, words
from ..functions.tables import settled, tasks_over
from .containment import containing

#: Days until a decision of a scope is overdue for review.
STALE_DAYS = {"strategic": 730, "architectural": 180, "library": 90, "config": 30, "operational": 14}
OTHER_STALE_DAYS = 90
#: Phrases of negation, opposed terms, and units of the assumption rules.
NEGATIONS = ["no longer", "deprecated", "replaced by", "removed", "migrated away from", "switched from", "moved away from", "abandoned", "dropped support for"]
OPPOSED = [("monolith", "microservice"), ("synchronous", "async"), ("sql", "nosql"), ("rest", "graphql"), ("rest", "grpc"), ("single tenant", "multi tenant"), ("single-tenant", "multi-tenant"), ("postgres", "mongodb"), ("postgres", "cassandra"), ("jwt", "session"), ("class", "functional"), ("oop", "functional"), ("on-premise", "cloud"), ("on-prem", "cloud")]
AMOUNT = r"\b(\d[\d,]*)\s*(req|rps|users|records|gb|mb|kb|ms)"
STOP_WORDS = ["which", "where", "while", "their", "about"]


def paginate(df: DataFrame, page: int, size: int) -> DataFrame:
    """The page's rows with total, total_pages and has_more."""
    from .graph import page_of

    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size)).withColumn("has_more", F.col("total") > page * size)
    return page_of(df, page, size).crossJoin(F.broadcast(total))


def rejected_candidates(decisions: DataFrame) -> DataFrame:
    """(id, decision_id, text): options of three characters or more that were not chosen."""
    o = decisions.select("id", "agent_decision", F.posexplode("options").alias("pos", "option"))
    o = o.where((F.length(F.trim("option")) >= 3) & (fold("option") != F.coalesce(fold("agent_decision"), F.lit(""))))
    return o.select(F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.col("pos").cast("string")), 256).alias("id"), F.col("id").alias("decision_id"), F.trim("option").alias("text"))


def dormant_alternatives(candidates: DataFrame, decisions: DataFrame, as_of: Column, min_days: int = 14, limit: int | None = 20, places: int = 3, follows: DataFrame | None = None) -> DataFrame:
    """Rejected options that no later decision of the user took up (neither text holds the other).

    follows (src, dst): with it, an option whose decision FOLLOWS no later decision is dormant whatever the texts say.
    """
    d = decisions.select(F.col("id").alias("decision_id"), "user_id", "created_at", "confidence")
    c = settled(candidates.join(d, "decision_id").withColumn("days", days_between(as_of, F.col("created_at"))).where(F.col("days") >= min_days).withColumn("option", F.lower("text")))
    later = decisions.where("agent_decision <> ''").groupBy("user_id", F.lower("agent_decision").alias("chosen")).agg(F.max("created_at").alias("last"))
    later = settled(later)
    options, choices = c.select("user_id", "option").distinct(), later.select("user_id", "chosen")
    inside = containing(options.withColumnRenamed("option", "needle"), choices.withColumnRenamed("chosen", "text"), ["user_id"]).toDF("user_id", "option", "chosen")
    around = containing(choices.withColumnRenamed("chosen", "needle"), options.withColumnRenamed("option", "text"), ["user_id"]).toDF("user_id", "chosen", "option")
    # compressed texts look smaller than they are, so neither table is left to a broadcast
    met = inside.unionByName(around).join(later.hint("merge"), ["user_id", "chosen"]).groupBy("user_id", "option").agg(F.max("last").alias("last"))
    c = c.join(met.hint("merge"), ["user_id", "option"], "left")
    revisited = F.col("last") > F.col("created_at")
    if follows is not None:
        at = decisions.select("id", "created_at")
        ahead = follows.join(at.toDF("src", "from"), "src").join(at.toDF("dst", "to"), "dst").where("to > from").select(F.col("src").alias("decision_id"), F.lit(True).alias("ahead")).distinct()
        c = c.join(ahead, "decision_id", "left")
        revisited = revisited & F.coalesce("ahead", F.lit(False))
    c = c.where(~F.coalesce(revisited, F.lit(False)))
    score = half_even(0.6 * F.least(F.col("days") / 365, F.lit(1.0)) + 0.4 * (1 - F.coalesce("confidence", F.lit(0.7))), places)
    out = c.select("id", "decision_id", "text", "days", score.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def threshold_of(scope: str | Column = "scope") -> Column:
    s = F.col(scope) if isinstance(scope, str) else scope
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STALE_DAYS.items() for x in kv]), s), F.lit(OTHER_STALE_DAYS))


def is_stale(as_of: Column, anchor: str = "created_at") -> Column:
    return F.coalesce(days_between(as_of, F.col(anchor)) > threshold_of(), F.lit(False))


def stale_decisions(decisions: DataFrame, as_of: Column, limit: int | None = 50) -> DataFrame:
    """(id, days, overdue), most overdue first: the filter comes before the limit."""
    d = decisions.withColumn("days", days_between(as_of, F.coalesce("last_reviewed_at", "created_at"))).withColumn("overdue", F.col("days") - threshold_of())
    d = d.where("overdue > 0").select("id", "scope", "days", "overdue")
    return d if limit is None else d.orderBy(F.desc("overdue"), "id").limit(limit)


def stale_files(files: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return files.where(F.col("last_modified") < as_of - F.make_dt_interval(F.lit(days))).select("file", days_between(as_of, F.col("last_modified")).alias("days_since"))


def file_last_modified(commits: DataFrame) -> DataFrame:
    return commits.select(F.explode("files_changed").alias("file"), "committed_at").groupBy("file").agg(F.max("committed_at").alias("last_modified"))


def contradiction(assumption: Column, later: Column) -> Column:
    """Confidence with which a later text contradicts an assumption, NULL if it does not; the first rule wins."""
    a, t = F.lower(assumption), F.lower(later)
    has = lambda c, s: F.contains(c, F.lit(s))
    negated = F.lit(False)
    for p in NEGATIONS:
        negated = negated | has(t, p)
    shared = F.exists(F.array_distinct(words(a)), lambda w: (F.length(w) > 4) & F.contains(t, w))
    opposed = F.lit(False)
    for x, y in OPPOSED:
        opposed = opposed | (has(a, x) & has(t, y)) | (has(a, y) & has(t, x))
    number = lambda s: F.regexp_replace(s, ",", "").cast("double")

    def amounts(c: Column) -> Column:
        return F.arrays_zip(find_all(c, AMOUNT, 1).alias("n"), find_all(c, AMOUNT, 2).alias("u"))

    grown = F.exists(amounts(a), lambda x: F.exists(amounts(t), lambda y: (x["u"] == y["u"]) & (number(y["n"]) >= number(x["n"]) * 10)))
    return F.when(negated & shared, 0.75).when(opposed, 0.80).when(grown, 0.70)


def assumption_violations(decisions: DataFrame, k: int = 50) -> DataFrame:
    """(id, assumption, later_id, confidence): the first of a user's next k decisions that contradicts an assumption."""
    order = Window.partitionBy("user_id").orderBy("created_at", "id")
    d = decisions.withColumn("n", F.row_number().over(order)).withColumn("last_equal", F.max("n").over(Window.partitionBy("user_id", "created_at")))
    d = settled(d)
    parts = tasks_over(d)
    a = d.select("id", "user_id", "last_equal", F.explode("assumptions").alias("assumption")).where(F.length(F.trim("assumption")) >= 5)
    text = F.concat_ws(" ", F.coalesce("trigger", F.lit("")), F.coalesce("context", F.lit("")), F.coalesce("agent_decision", F.lit("")))
    later = d.select("user_id", F.col("n").alias("m"), F.col("id").alias("later_id"), text.alias("later_text"))
    # the next k places of a user lie in two stretches of k places
    stretch = lambda c: F.floor(c / k)
    a = a.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(F.col("last_equal") + 1), stretch(F.col("last_equal") + k)))))
    # an assumption is sent to two stretches
    later = later.withColumn("stretch", stretch(F.col("m"))).repartition(2 * parts, "user_id", "stretch")
    pairs = a.repartition(2 * parts, "user_id", "stretch").join(later, ["user_id", "stretch"]).where((F.col("m") > F.col("last_equal")) & (F.col("m") <= F.col("last_equal") + k))
    hits = pairs.withColumn("confidence", contradiction(F.col("assumption"), F.col("later_text"))).where("confidence IS NOT NULL")
    return hits.groupBy("id", "assumption").agg(F.min(F.struct("m", "later_id", "confidence")).alias("x")).select("id", "assumption", "x.later_id", "x.confidence")


def alert_violations(decisions: DataFrame, alerts: DataFrame) -> DataFrame:
    """(id, assumption, alert): two shared longer words, or the only one of a short assumption. Words meet alerts through their rarest run of characters."""
    a = decisions.select("id", "project_name", F.explode("assumptions").alias("assumption"))
    a = a.withColumn("keys", F.filter(F.array_distinct(words(F.lower("assumption"))), lambda w: (F.length(w) > 4) & ~w.isin(STOP_WORDS)))
    asked = a.select("id", "project_name", "assumption", F.size("keys").alias("keys"), F.explode("keys").alias("needle")).distinct()
    texts = alerts.select("project_name", "alert", F.lower("text").alias("text"))
    met = asked.join(containing(asked, texts, ["project_name"]), ["project_name", "needle"]).join(texts, ["project_name", "text"])
    n = met.groupBy("id", "assumption", "keys", "alert").agg(F.countDistinct("needle").alias("n"))
    return n.where("n >= 2 OR (keys = 1 AND n = 1)").select("id", "assumption", "alert")


def within_budget(df: DataFrame, by: list[str], order: list[Column], chars: Column, budget: int) -> DataFrame:
    """Ranked rows of each group while the running sum of a quarter of their characters stays in the budget.

    Rows are dealt in ranges of (group, order); a row's sum is that of its range up to it, and that of the group's
    ranges before it, one number each. So a group of any size is spread over tasks. `order` must tell all rows apart.
    """
    cost = df.withColumn("cost", F.floor(chars / 4).cast("bigint"))
    dealt = settled(cost.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "range").agg(F.sum("cost").alias("all"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    # ranges that begin beyond the budget hold no row that stays
    kept = dealt.join(sums.where(F.col("offset") <= budget), [*by, "range"])
    inside = Window.partitionBy(*by, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = kept.withColumn("spent", F.col("offset") + F.sum("cost").over(inside))
    return spent.where(F.col("spent") <= budget).drop("cost", "range", "offset")


def truncate_recent(messages: DataFrame, chars: int) -> DataFrame:
    """The most recent messages of each conversation whose lengths sum to `chars` at most."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn_index")).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("kept_chars", F.sum(F.length("content")).over(w)).where(F.col("kept_chars") <= chars)


def pack_batches(df: DataFrame, by: str, order: str, text: str, max_items: int = 5, max_tokens: int = 8000) -> DataFrame:
    """(by, order, batch): texts in order, at most max_items and max_tokens a batch, an oversize one alone.

    The packing depends on all before it, so it is a fold over a group's sizes (not its texts), on the JVM.
    """
    size = (F.floor(F.length(text) / 4) + 1).cast("int")
    g = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), size.alias("s")))).alias("rows"))
    state = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("items"), F.lit(0).alias("tokens"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        fits = (a["items"] > 0) & (a["items"] < max_items) & (a["tokens"] + r["s"] <= max_tokens)
        batch = F.when(fits, a["batch"]).otherwise(a["batch"] + 1)
        return F.struct(batch.alias("batch"), F.when(fits, a["items"] + 1).otherwise(1).alias("items"), F.when(fits, a["tokens"] + r["s"]).otherwise(r["s"]).alias("tokens"), F.array_append(a["out"], batch).alias("out"))

    packed = g.select(by, F.explode(F.arrays_zip("rows", F.aggregate("rows", state, step, lambda a: a["out"]).alias("out"))).alias("x"))
    return packed.select(by, F.col("x.rows.o").alias(order), F.col("x.out").alias("batch"))


def notifications_from(kind: str, rows: DataFrame, user: str, subject: str, text: str) -> DataFrame:
    """(type, user_id, subject, text, payload) of rows; text is a template with {subject}."""
    body = F.replace(F.lit(text), F.lit("{subject}"), F.col(subject).cast("string"))
    return rows.select(F.lit(kind).alias("type"), F.col(user).alias("user_id"), F.col(subject).alias("subject"), body.alias("text"), F.to_json(F.struct(F.lit(kind).alias("type"), F.col(subject).alias("subject"))).alias("payload"))


def notify_contradictions(contradicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each user of either side of a contradiction."""
    from .graph import symmetric

    pairs = symmetric(contradicts).select("id", "other").distinct().join(decisions.select("id", "user_id"), "id")
    return notifications_from("contradiction", pairs, "user_id", "other", "A decision of yours contradicts decision {subject}").distinct()


def notices(kind: str, rows: DataFrame, subject: Column, title: str, text: Column, **payload: Column) -> DataFrame:
    """(type, user_id, subject, title, text, payload) of rows with a user; the payload is JSON."""
    said = F.to_json(F.struct(*[c.alias(n) for n, c in payload.items()]))
    return rows.where("user_id IS NOT NULL").select(F.lit(kind).alias("type"), "user_id", subject.cast("string").alias("subject"), F.lit(title).alias("title"), text.alias("text"), said.alias("payload"))


def notify_assumptions(violations: DataFrame, decisions: DataFrame) -> DataFrame:
    """A notice for each violation (id, assumption, later_id) to the user who assumed; texts are cut as the messages want."""
    d = decisions.select("id", "user_id", F.coalesce("trigger", F.lit("")).alias("trigger"))
    v = violations.join(d, "id").join(d.select(F.col("id").alias("later_id"), F.col("trigger").alias("later")), "later_id")
    text = F.concat(
        F.lit('Your assumption "'), F.substring("assumption", 1, 100), F.lit('" in decision "'), F.substring("trigger", 1, 60), F.lit('" may be invalidated by a newer decision: "'), F.substring("later", 1, 60), F.lit('".')
    )
    return notices("assumption_invalid", v, F.col("id"), "Decision assumption may be outdated", text, decision_id=F.col("id"), assumption=F.col("assumption"), invalidating_decision_id=F.col("later_id"))


def notify_stale(decisions: DataFrame, as_of: Column) -> DataFrame:
    """A notice for each stale decision to its user."""
    d = decisions.select("id", "user_id", F.coalesce("trigger", F.lit("")).alias("trigger"))
    s = stale_decisions(decisions, as_of, None).join(d, "id")
    text = F.concat(F.lit("Your "), "scope", F.lit(' decision "'), F.substring("trigger", 1, 80), F.lit('" is '), F.col("days").cast("string"), F.lit(" days old and may need to be reviewed or confirmed still relevant."))
    return notices("stale_decision", s, F.col("id"), "Stale decision needs review", text, decision_id=F.col("id"), scope=F.col("scope"), days_old=F.col("days"))


def notify_dormant(dormant: DataFrame, decisions: DataFrame) -> DataFrame:
    """A notice for each dormant alternative (id, decision_id, text, days, score) to the user who rejected it."""
    d = decisions.select(F.col("id").alias("decision_id"), "user_id", F.coalesce("trigger", F.lit("")).alias("trigger"))
    text = F.concat(
        F.lit('Alternative "'), F.substring("text", 1, 80), F.lit('" from the decision "'), F.substring("trigger", 1, 60), F.lit('" has been dormant for '), F.col("days").cast("string"), F.lit(" days and may now be viable.")
    )
    return notices("dormant_alternative", dormant.join(d, "decision_id"), F.col("id"), "Unexplored alternative worth revisiting", text, candidate_id=F.col("id"), reconsider_score=F.col("score"), days_dormant=F.col("days"))

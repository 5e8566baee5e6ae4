"""Projections, filters and row rules over decisions and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_match, clamp, contains, filled, first_filled

SPAN = "start_char int, end_char int"
#: Columns that a patch may change, and the column that it changes.
PATCHABLE = {"trigger": "trigger", "context": "context", "agent_decision": "agent_decision", "agent_rationale": "agent_rationale", "human_decision": "human_decision", "human_rationale": "human_rationale", "verbatim_quote": "verbatim_decision", "scope": "scope"}


def visible_to(df: DataFrame, user_id, strict: bool = False) -> DataFrame:
    """Rows of one tenant; shared rows (null user) too unless strict."""
    own = F.col("user_id") == user_id
    return df.where(own if strict else own | F.col("user_id").isNull())


def normalize_decisions(df: DataFrame) -> DataFrame:
    """One name for decision and rationale: the legacy pair fills gaps and goes."""
    for new, old in (("agent_decision", "decision"), ("agent_rationale", "rationale")):
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    return df


def with_display_defaults(df: DataFrame) -> DataFrame:
    shown = {"trigger": "(untitled)", "context": "(no context)", "agent_decision": "(not recorded)", "agent_rationale": "(not recorded)"}
    out = {c: F.coalesce(filled(c), F.lit(d)) for c, d in shown.items()}
    return df.withColumns(out | {"confidence": F.coalesce("confidence", F.lit(0.0)), "source": F.coalesce("source", F.lit("unknown"))})


def apply_extraction_defaults(df: DataFrame) -> DataFrame:
    out = {"trigger": F.coalesce(filled("trigger"), F.lit("Unknown trigger")), "confidence": F.coalesce("confidence", F.lit(0.5))}
    for c in ("context", "agent_decision", "agent_rationale"):
        out[c] = F.coalesce(filled(c), F.lit(""))
    if "options" in df.columns:
        out["options"] = F.coalesce("options", F.array().cast("array<string>"))
    return df.withColumns(out)


def decode_spans(df: DataFrame) -> DataFrame:
    """start_char and end_char of the JSON span (NULL when malformed), and the quote shown for it."""
    span = F.from_json("decision_span", SPAN)
    return df.withColumns({"start_char": span["start_char"], "end_char": span["end_char"], "quote": first_filled("verbatim_decision", "verbatim_trigger")})


def filter_source(df: DataFrame, source: str) -> DataFrame:
    return df.where(F.coalesce("source", F.lit("unknown")) == source)


def filter_project(df: DataFrame, project: str) -> DataFrame:
    return df.where(F.col("project_name") == project)


def filter_decisions(df: DataFrame, as_of: Column, q: str | None = None, source: str | None = None, min_conf: float | None = None, days: int | None = None) -> DataFrame:
    """All given criteria at once; q looks into trigger, decision and (if collected) entity names; days counts from the start of the day."""
    if q:
        hit = contains("trigger", q) | F.coalesce(contains("agent_decision", q), F.lit(False))
        if "entities" in df.columns:
            hit = hit | F.coalesce(any_match("entities", lambda e: contains(e, q)), F.lit(False))
        df = df.where(hit)
    if source:
        df = filter_source(df, source)
    if min_conf is not None:
        df = df.where(F.col("confidence") >= min_conf)
    if days is not None:
        df = df.where(F.col("created_at") >= F.date_trunc("day", as_of) - F.make_dt_interval(F.lit(days)))
    return df


def select_edges(edges: DataFrame, rels: list[str], min_conf: float = 0.0) -> DataFrame:
    """Edges of the wanted kinds; an absent confidence or score passes any bound."""
    out = edges.where(F.col("rel").isin(rels))
    for c in ("confidence", "score"):
        if c in edges.columns:
            out = out.where(F.col(c).isNull() | (F.col(c) >= min_conf))
    return out


def edge_weight(df: DataFrame) -> DataFrame:
    """weight_shown: the first of weight, score, confidence that is not 0 or absent, else 1, within [0, 1]."""
    known = [F.nullif(F.col(c), F.lit(0.0)) for c in ("weight", "score", "confidence") if c in df.columns]
    return df.withColumn("weight_shown", clamp(F.coalesce(*known, F.lit(1.0))))


def needs_review(df: DataFrame) -> DataFrame:
    return df.where(F.col("human_rationale").isNull())


def tag_sources(df: DataFrame) -> DataFrame:
    """source with `unknown` for NULL, and whether it was tagged."""
    return df.withColumns({"tagged": F.col("source").isNull(), "source": F.coalesce("source", F.lit("unknown"))})


def normalize_projects(df: DataFrame) -> DataFrame:
    """Rows whose project name changes when folded to lower case."""
    return df.select("id", F.col("project_name").alias("old_name"), F.lower("project_name").alias("new_name")).where("old_name <> new_name")


def apply_updates(decisions: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """Patch rows (id, any of PATCHABLE): NULL keeps the old value; edited rows get edited_at and edit_count + 1."""
    given = [c for c in patches.columns if c in PATCHABLE]
    p = patches.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in given])
    out = decisions.join(p, F.col("id") == F.col("_id"), "left")
    old = lambda c, kind: F.col(c) if c in decisions.columns else F.lit(None).cast(kind)
    changes = {PATCHABLE[c]: F.coalesce(F.col(f"_{c}"), old(PATCHABLE[c], "string")) for c in given}
    hit = F.col("_id").isNotNull()
    changes["edited_at"] = F.when(hit, as_of).otherwise(old("edited_at", "timestamp_ntz"))
    changes["edit_count"] = F.coalesce(old("edit_count", "int"), F.lit(0)) + hit.cast("int")
    return out.withColumns(changes).drop("_id", *[f"_{c}" for c in given])


def mark_reviewed(decisions: DataFrame, reviews: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(decisions with last_reviewed_at and notes, review ids that exist nowhere)."""
    r = reviews.select(F.col("id").alias("_id"), F.col("notes").alias("_notes"))
    stamped = decisions.join(r, F.col("id") == F.col("_id"), "left")
    notes = F.col("review_notes") if "review_notes" in decisions.columns else F.lit(None).cast("string")
    stamped = stamped.withColumns({"last_reviewed_at": F.when(F.col("_id").isNotNull(), as_of).otherwise(F.col("last_reviewed_at")), "review_notes": F.coalesce("_notes", notes)}).drop("_id", "_notes")
    return stamped, reviews.join(decisions.select("id"), "id", "left_anti").select("id")


def validate_decisions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a reason): length bounds on trimmed texts, 1 to 50 options, confidence in [0, 1]."""

    def length(c: str) -> Column:
        return F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))

    reason = F.when((length("trigger") < 1) | (length("trigger") > 5000), "trigger")
    reason = reason.when((length("context") < 1) | (length("context") > 10000), "context")
    if "options" in df.columns:
        n = F.size(F.coalesce("options", F.array().cast("array<string>")))
        reason = reason.when((n < 1) | (n > 50), "options").when(F.exists("options", lambda o: (F.length(F.trim(o)) < 1) | (F.length(F.trim(o)) > 1000)), "option")
    reason = reason.when((length("agent_decision") < 1) | (length("agent_decision") > 10000), "agent_decision")
    reason = reason.when((length("agent_rationale") < 1) | (length("agent_rationale") > 10000), "agent_rationale")
    reason = reason.when(F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence")
    judged = df.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")

"""Writing decisions out: JSON, CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import decisions_with_entities


def export_json(decisions: DataFrame, entities: DataFrame, involves: DataFrame, path: str, source: str | None = None, limit: int | None = 10_000) -> None:
    """The newest decisions with their entities, as JSON lines."""
    json_rows(decisions, entities, involves, source, limit).write.mode("overwrite").json(path)


def json_rows(decisions: DataFrame, entities: DataFrame, involves: DataFrame, source: str | None = None, limit: int | None = 10_000) -> DataFrame:
    """The newest `limit` decisions of a source with their entities; None takes all."""
    d = decisions if source is None else decisions.where(F.coalesce("source", F.lit("unknown")) == source)
    if limit is not None:
        d = d.orderBy(F.desc("created_at"), "id").limit(limit)
    return decisions_with_entities(d, entities, involves)


def csv_rows(df: DataFrame) -> DataFrame:
    """Arrays as text joined by `; `, other nested columns as JSON."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((F.array_join(c, "; ") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c).alias(name))
    return df.select(*out)


def export_csv(df: DataFrame, path: str) -> None:
    csv_rows(df).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def markdown_sections(decisions: DataFrame, entities: DataFrame, involves: DataFrame) -> DataFrame:
    """(project_name, turn_index, created_at, id, section): one section for each decision."""
    d = decisions_with_entities(decisions, entities, involves)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["name"]))), ", ")
    body = F.concat_ws(
        "\n\n",
        F.concat(F.lit("## "), F.coalesce("trigger", F.lit("(untitled)"))),
        F.concat(F.lit("**Context:** "), F.coalesce("context", F.lit("(no context)"))),
        F.concat(F.lit("**Decision:** "), F.coalesce("agent_decision", F.lit("(not recorded)"))),
        F.concat(F.lit("**Rationale:** "), F.coalesce("agent_rationale", F.lit("(not recorded)"))),
        F.when(names != "", F.concat(F.lit("**Entities:** "), names)),
    )
    return d.select("project_name", "turn_index", "created_at", "id", body.alias("section"))


def export_markdown(decisions: DataFrame, entities: DataFrame, involves: DataFrame, path: str) -> None:
    """One folder for each project, sections in the order of turn, time and id, ranges of them in files."""
    s = markdown_sections(decisions, entities, involves)
    order = ["project_name", F.col("turn_index").asc_nulls_last(), "created_at", "id"]
    s.repartitionByRange(*order).sortWithinPartitions(*order).select("project_name", F.concat("section", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("project_name").text(path)

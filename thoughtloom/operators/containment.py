"""Texts inside texts, met through grams instead of by all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grams(c: str, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (size - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(size))))


def containing(needles: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, needle, text) of needles (*by, needle) that are inside texts (*by, text) of the same group; both sides once each.

    A text that holds a needle holds the needle's rarest run of three characters (or the needle itself, if it is
    shorter), so both meet in that one run. Needles with a run that no text of their group has are out before the join.
    Runs of one and two characters are made only in groups that have so short a needle. Sizes of exploded runs are
    underestimated, so they are never sent to the driver for a broadcast.
    """
    needles, texts = needles.where("needle <> ''").select(*by, "needle").distinct(), texts.where("text IS NOT NULL").select(*by, "text").distinct()
    short = needles.where(F.length("needle") < 3)
    brief = texts.join(short.select(*by).distinct().hint("merge"), by, "left_semi").select(*by, "text", F.explode(F.array_union(_grams("text", 1), _grams("text", 2))).alias("run")).where(F.length("run") < 3)
    met = brief.join(short.select(*by, F.col("needle").alias("run")).hint("merge"), [*by, "run"]).select(*by, F.col("run").alias("needle"), "text")
    runs = texts.where(F.length("text") >= 3).select(*by, "text", F.explode(_grams("text", 3)).alias("run"))
    often = runs.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("texts"))
    own = needles.where(F.length("needle") >= 3).select(*by, "needle", F.explode(_grams("needle", 3)).alias("run"))
    rarest = own.join(often.hint("merge"), [*by, "run"], "left").groupBy(*by, "needle").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "run")).alias("x"))
    asked = rarest.where("x.texts > 0").select(*by, "needle", F.col("x.run").alias("run"))
    return met.unionByName(asked.join(runs.hint("merge"), [*by, "run"]).where(F.contains("text", F.col("needle"))).select(*by, "needle", "text"))

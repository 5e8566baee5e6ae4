"""Mixing sources to target weights, with DataFrame operations alone.

Sizes are word counts. The targets are the water filling of the total over the sources: each source gets
its share by weight, none more than `most` times its own size, and what is cut off is shared again by
weight. Documents of a source are put in the order of a hash-random key (md5 of the id), and a distributed
prefix sum over that order cuts the source at its exact budget; whole passes (epochs) come first when the
target exceeds the size, and the document at the cut gives the words that are left.

Scale: the key is uniform, so its leading hex digits split every source into ranges of equal size without
sampling. Prefix sums run inside (source, range) and over the ranges' totals, so no task holds a source,
however large; only ids, sizes and keys are shuffled for the decision.

Defined cases: a null or empty text has size 0 and nothing is taken; a null source is a source of its
own, the last; rows without an id have a key of their text's; rows that repeat an id share a key, are ordered by
source and size, and are each counted; an empty table gives no rows; targets are floored to whole words when
cutting. The water filling has one row for each source in one task: its bound is the number of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, stored

#: Repeating weights in the order of the sources.
WEIGHTS = (5.0, 2.0, 1.0)


def sized(docs: DataFrame, *keys: str | Column) -> DataFrame:
    """(doc_id, source, keys, size): size is the number of words of the text."""
    return docs.select("doc_id", "source", *keys, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    With r = most * source_size / weight ascending, the sources that reach their cap are a prefix; the level
    of the others is what the prefix leaves, by weight. One row for each source from here on.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumns(
        {
            "cap_before": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_left": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(everything).cast("double"),
        }
    )
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    # the first source of the order that stays below its cap sets the level for itself and all after it
    s = s.withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything).getField("level")
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, digits: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, keys) for each row of docs; digits: hex digits of the key that make a range; keys: columns that tell rows of one id apart."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    rows = stored(sized(docs, key.alias("key"), *keys).withColumn("range", F.substring("key", 1, digits)), "sizes")
    part = ("source", "range")
    totals = rows.groupBy(*part).agg(F.sum("size").alias("n"))
    before = stored(totals.select(*part, (F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).alias("offset")), "offsets")
    goal = stored(targets(totals.select("source", F.col("n").alias("size")), weights, most), "targets")
    plan = before.join(goal, before.source.eqNullSafe(goal.source)).select(before.source.alias("s"), before.range.alias("r"), "offset", "source_size", "target")
    inside = Window.partitionBy(*part).orderBy("key", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = run.join(plan, run.source.eqNullSafe(plan.s) & (run.range == plan.r))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target") - whole * F.col("source_size"))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("offset") - F.col("inner")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + rest).cast("bigint").alias("taken"), *keys)


def op6(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def copies(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mixture's rows, by a key that is unique in both: each document once for each pass, the document at a source's cut with its last pass shortened to the words taken."""
    m = mixed.where("taken > 0").select(key, "size", "taken")
    pieces = m.withColumn("words", F.explode(F.expr("transform(sequence(0, cast((taken - 1) div size as int)), i -> least(size, taken - i * size))")))
    pieces = pieces.select(key, "size", "words")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    columns = [F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")).alias("text") if n == "text" else F.col(n) for n in docs.columns]
    joined = docs.join(pieces, key).select(*columns)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast("bigint"))
    return joined.select(*docs.columns)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents: ids repeat where a source is passed more than once. Rows that repeat an id, or have none, are taken each."""
    rows = keyed(docs)
    return copies(rows, mix(rows, keys=("doc",)), "doc").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
         sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl
  FROM s),
l AS (SELECT arg_min((total - cb) / wl, cap / w) AS level FROM c WHERE (total - cb) / wl * w < cap),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM c, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (e * size + greatest(0, least(size, floor(target - e * source_size)::BIGINT - b)))::BIGINT AS taken
FROM p
"""

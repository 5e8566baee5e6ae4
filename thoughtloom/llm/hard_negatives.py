"""Operator 11: hard negatives by exact scores from a residue number system.

Vectors become integers. A block of anchors and a block of rows are multiplied in float32 once for each of several small
primes: residues are at most half a prime, so a product over 64 components is below 2^24 and exact. Chinese
remaindering with balanced digits gives the signed scores; the primes are as many as twice the largest squared norm
needs, which bounds every score. A first product finds each anchor's positives, a second one, given their scores, the
negatives in each positive's window. A pair of blocks is one task's group and gives a few rows an anchor.

Rows with a null label or vector, with null or non-finite components, or whose squared norm does not fit a long take
no part. Vectors of other lengths count as continued by zeros. Rows without an id are candidates after all others of
their score, never anchors; repeated ids are rows of their own, in any order. Without rows the result is empty; other
columns are ignored. Blocks are dealt by a hash of the row, so hot labels and copies need no care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keyed, stored

STEP = 64  # components a float32 product sums: 64 * 510^2 < 2^24
LARGEST_PRIME = 1021
NONE = np.iinfo(np.int64).min
BLOCK = 8192
SLICE = 128


def primes(bound: int) -> list[int]:
    """Falling primes, two at least, whose product exceeds 2 * bound."""
    out, product, p = [], 1, LARGEST_PRIME
    while len(out) < 2 or product <= 2 * bound:
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
        p -= 2
    return out


def residues(q: np.ndarray, p: int) -> np.ndarray:
    """q modulo p, balanced around 0, as float32."""
    r = np.mod(q, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def scores(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact a @ b.T of integer matrices, given as their residues for each modulus."""
    value, radix = None, 1
    for p, x, y in zip(moduli, a, b):
        r = np.zeros((len(x), len(y)), np.int32)
        for c in range(0, x.shape[1], STEP):
            r = np.mod(r + (x[:, c : c + STEP] @ y[:, c : c + STEP].T).astype(np.int32), np.int32(p))
        if value is not None:
            r = np.mod((r - np.mod(value, p)) * pow(radix, -1, p), p)
        digit = np.where(r > p // 2, r - p, r).astype(np.int64)
        value = digit if value is None else value + digit * radix
        radix *= p
    return value


def best(s: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k times (line numbers, columns) of each line's greatest entry left, the first of equal ones; overwrites s."""
    lines = np.arange(len(s))
    for _ in range(min(k, s.shape[1])):
        at = s.argmax(axis=1)
        there = s[lines, at] != NONE
        yield lines[there], at[there]
        s[lines, at] = NONE


def share(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(score * percent / 100) without overflow."""
    return score // 100 * percent + score % 100 * percent // 100


def _matrix(lists: pa.ChunkedArray, size: int) -> np.ndarray:
    lists = lists.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), size), np.int64)
    out[np.arange(size)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def prepared(df: DataFrame, anchor: Column, scale: int) -> DataFrame:
    """(row, vec_id, label, anchor, q, norm) of the rows that take part."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < 2.0**31 - 1))
    q = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("int"))
    norm = F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = keyed(df.select("vec_id", F.col("label").cast("bigint"), "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor")), "vec_id")
    rows = rows.where("label IS NOT NULL AND embedding IS NOT NULL").where(whole).select(F.col("doc").alias("row"), "vec_id", "label", "anchor", q.alias("q"))
    return rows.withColumn("norm", norm).where(F.col("norm") < 2.0**61)


def _meet(rows: DataFrame, asked: DataFrame, n: int, n_asked: int, pick, schema: str) -> DataFrame:
    """pick(asked block, rows block) for all pairs of blocks; each side is repeated once for each block of the other."""
    left, right = -(-n_asked // BLOCK), -(-n // BLOCK)
    deal = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    columns = ["row", "vec_id", "label", "q"]
    a = asked.select(*columns, "windows", F.lit(True).alias("asked"), deal(left).alias("i"), every(right).alias("j"))
    b = rows.select(*columns, F.lit(None).cast("array<bigint>").alias("windows"), F.lit(False).alias("asked"), deal(right).alias("j"), every(left).alias("i"))

    def group(t: pa.Table) -> pa.Table:
        return pick(t.filter(t["asked"]), t.filter(pa.compute.invert(t["asked"])).sort_by([("vec_id", "ascending"), ("row", "ascending")]))

    return a.unionByName(b).repartition(left * right, "i", "j").groupBy("i", "j").applyInArrow(group, schema)


def mine(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), in whole percent of the positive's score.

    anchor: which rows of df (vec_id, label, embedding) ask. Scores are inner products of floor(scale * component).
    """
    rows = stored(prepared(df, anchor, scale), "vectors")
    n, n_asked, norm, size = rows.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max("norm"), F.lit(0.0)), F.coalesce(F.max(F.size("q")), F.lit(0))).head()
    if not n_asked:
        return df.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    moduli = primes(int(norm) + 1)
    found = "anchor bigint, anchor_id bigint, asked bigint, row bigint, vec_id bigint, score bigint"

    def product(take):
        """Slices of an asked block against a block of rows; take(slice, block, scores) yields (asked, lines, columns, scores)."""

        def pick(a: pa.Table, b: pa.Table) -> pa.Table:
            rb, out = [residues(_matrix(b["q"], size), p) for p in moduli], []
            side = lambda t: {c: t[c].to_numpy() for c in ("row", "label")}
            bs = side(b)
            for first in range(0, a.num_rows if b.num_rows else 0, SLICE):
                part = a.slice(first, SLICE)
                qa = _matrix(part["q"], size)
                for asked, lines, at, s in take(part, side(part), bs, scores([residues(qa, p) for p in moduli], rb, moduli)):
                    lines, at = pa.array(lines), pa.array(at)
                    out.append(pa.table([part["row"].take(lines), part["vec_id"].take(lines), pa.array(asked), b["row"].take(at), b["vec_id"].take(at), pa.array(s)], names=["anchor", "anchor_id", "asked", "row", "vec_id", "score"]))
            return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 6, names=["anchor", "anchor_id", "asked", "row", "vec_id", "score"])

        return pick

    def same(part, a, b, s):
        own = np.where((a["label"][:, None] == b["label"]) & (a["row"][:, None] != b["row"]), s, NONE)
        for lines, at in best(own, positives):
            yield np.zeros(len(lines), np.int64), lines, at, s[lines, at]

    def inside(part, a, b, s):
        other = a["label"][:, None] != b["label"]
        asked = [sorted(w) for w in part["windows"].to_pylist()]
        for k in range(max(map(len, asked))):
            have = np.array([len(w) > k for w in asked])
            target = np.array([w[k] if len(w) > k else 0 for w in asked], np.int64)
            lowest, highest = -share(-target, low), share(target, high)
            open_ = np.where(other & have[:, None] & (s >= lowest[:, None]) & (s <= highest[:, None]), s, NONE)
            for lines, at in best(open_, negatives):
                yield target[lines], lines, at, s[lines, at]

    def first(df: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor", "asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = rows.where("anchor").withColumn("windows", F.lit(None).cast("array<bigint>"))
    near = stored(first(_meet(rows, asked, n, n_asked, product(same), found), positives), "positives")
    windows = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("windows"))
    hard = first(_meet(rows, rows.where("anchor").join(windows, "row"), n, n_asked, product(inside), found), negatives)
    hard = hard.select("anchor", F.col("asked").alias("score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = stored(
        near.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), "score").join(hard, ["anchor", "score"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score"),
        "negatives",
    )
    forget(rows, near)
    return out


def op11(df: DataFrame) -> DataFrame:
    """Ids divisible by 7 take the next label; ids divisible by 50 ask."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return mine(df.withColumn("label", label), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 3
"""

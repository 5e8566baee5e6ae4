"""Operator 12: whitening of embeddings by refined eigenvectors of their covariance.

The covariance is an exact integer result: vectors become integers, Spark sums them, every task multiplies its batches
centred at the rounded mean (products split so that each is exact), and Spark adds the tasks' matrices. Its size is
the square of the dimension whatever the number of rows. On the driver float32 eigenvectors are the start; the
iterations of Ogita and Aishima, all matrix products in extended precision, then double the correct digits in each
round. Where eigenvalues lie closer than the error of a round can tell apart, the matrix is shifted by them and solved
inside their subspace.

The dimension is the commonest length of a non-null, non-empty vector (the greater of equally common ones). Rows with a
null vector, another length, null or non-finite entries, or entries whose integer does not fit a long take no part.
Rows without an id or with a repeated one are rows like others; other columns are ignored; without rows the result is
empty. A component without variance (at most 1e-14 of all) has whitened 0. `deviation` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SCALE, SHIFT = 1024, 100_000
FLAT = 1e-14
LIMB = 20
HIGH = np.longdouble
OUT = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)
CELL = "i int, j int, v decimal(38,0)"


def integers(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, x): rows of an Arrow batch that take part, and their integers."""
    at = np.flatnonzero(pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False) == size)
    c = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    whole = (np.abs(c) < 2.0**52).all(axis=1)
    return at[whole], np.floor(SCALE * c[whole]).astype(np.int64) + SHIFT


def gram(y: np.ndarray) -> np.ndarray:
    """Exact y^T y as Python integers: limbs of 20 bits, so that the float64 product of up to 2^13 rows is exact."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    limbs = max(1, -(-int(np.abs(y).max(initial=0)).bit_length() // LIMB))
    for first in range(0, len(y), 1 << (53 - 2 * LIMB)):
        part = y[first : first + (1 << (53 - 2 * LIMB))]
        sign, size = np.sign(part), np.abs(part)
        cut = [(sign * ((size >> (LIMB * k)) & ((1 << LIMB) - 1))).astype(np.float64) for k in range(limbs)]
        for a in range(limbs):
            for b in range(limbs):
                total += (cut[a].T @ cut[b]).astype(np.int64).astype(object) << (LIMB * (a + b))
    return total


def _cells(pairs: list[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, v = zip(*pairs) if pairs else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(x) for x in v], pa.decimal128(38, 0))], names=["i", "j", "v"])


def _summed(df: DataFrame, per_batch, schema: str = CELL) -> dict[tuple[int, int], int]:
    """Sums of cells (i, j, v) that tasks make from their batches; their number depends on the dimension alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            for i, j, v in per_batch(b.column(0)):
                total[i, j] = total.get((i, j), 0) + v
        yield _cells([(i, j, v) for (i, j), v in total.items()])

    found = df.select("embedding").mapInArrow(task, schema).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return {(r.i, r.j): int(r.v) for r in found}


def dimension(df: DataFrame) -> int:
    best = df.select(F.size("embedding").alias("size")).where("size > 0").groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).head()
    return best["size"] if best else 0


@dataclass(frozen=True)
class Fit:
    """n, per-dimension sums, and the covariance's eigenvalues (falling) with eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def covariance(df: DataFrame, size: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance in extended precision), the covariance rounded once from its exact rational value."""

    def sums_of(vectors):
        _, x = integers(vectors, size)
        yield -1, 0, len(x)
        for i, s in enumerate(x.astype(object).sum(axis=0) if len(x) else ()):
            yield i, 0, s

    total = _summed(df, sums_of)
    n = total.get((-1, 0), 0)
    if not n:
        return 0, [], np.zeros((0, 0), HIGH)
    sums = [total[i, 0] for i in range(size)]
    centre = np.array([s // n for s in sums], dtype=np.int64)
    upper = np.triu_indices(size)

    def products_of(vectors):
        g = gram(integers(vectors, size)[1] - centre)
        return zip(upper[0].tolist(), upper[1].tolist(), g[upper].tolist())

    g = _summed(df, products_of)
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    out = np.empty((size, size), HIGH)
    for (i, j), v in g.items():
        exact = Fraction(n * v - rest[i] * rest[j], n * n)
        near = float(exact)
        out[i, j] = out[j, i] = HIGH(near) + HIGH(float(exact - Fraction(near)))
    return n, sums, out


def _correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One iteration for columns x of eigenvectors of a: (better x, eigenvalues, least separable gap, size of the change)."""
    r = np.eye(x.shape[1], dtype=HIGH) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # unequal roundings of the halves would turn into lost orthogonality at small gaps
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    rounding = len(a) * float(np.finfo(HIGH).eps) * norm(a)
    least = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r) + rounding)
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > least
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, least, float(np.abs(e).max(initial=0))


def _clusters(values: np.ndarray, least: float) -> list[np.ndarray]:
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > least) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigen(cov: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors) of a symmetric matrix, to double precision."""
    scale = HIGH(np.abs(cov).max(initial=0)) or HIGH(1)
    a = cov / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    for _ in range(rounds):
        x, values, least, change = _correct(a, x)
        for c in _clusters(values, least):
            shifted = a - values[c].mean() * np.eye(len(a), dtype=HIGH)
            inside = x[:, c].T @ (shifted @ x[:, c])
            size = np.abs(inside).max() or HIGH(1)
            turned = x[:, c] @ np.linalg.eigh((inside / size).astype(np.float64))[1].astype(HIGH)
            x[:, c] = _correct(shifted, turned)[0]
        if change < 1e-17:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


def fit(df: DataFrame) -> Fit | None:
    """The whitening of df's column `embedding`; None without a vector that takes part."""
    size = dimension(df)
    n, sums, cov = covariance(df, size) if size else (0, [], None)
    if not n:
        return None
    values, vectors = eigen(cov)
    return Fit(n, tuple(sums), values, vectors, float(np.trace(cov)))


class Whitener:
    """Rows of x to their whitened components and exact deviations; plain arrays, so that tasks can hold it."""

    def __init__(self, model: Fit, most: int):
        self.n, self.sums = model.n, model.sums
        self.centre = np.array([s // model.n for s in model.sums], dtype=np.int64)
        self.rest = np.array([(s - model.n * int(c)) / model.n for s, c in zip(model.sums, self.centre)])
        values = model.values[:most]
        self.explained = values / model.trace if model.trace > 0 else np.zeros(len(values))
        self.live = self.explained > FLAT
        self.project = np.where(self.live, model.vectors[:, :most], 0) / np.sqrt(np.where(self.live, values, 1))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.rest) @ self.project

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row: in longs where the largest entry proves that they suffice, else in Python's integers."""
        shift = np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre)], dtype=object)
        y = x - self.centre
        top = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if top * top * max(1, x.shape[1]) < 2**63:
            d = self.n * y - shift.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * y.astype(object) - shift
        return [v if v < 2**63 else None for v in (d * d).sum(axis=1).tolist()]


def identity_error(df: DataFrame, w: Whitener, size: int) -> float:
    """Largest absolute entry of (covariance of the whitened rows - identity), over components with variance."""
    k = w.project.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            z = w.whitened(integers(b.column(0), size)[1])
            total[0] += z.sum(axis=0)
            total[1:] += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in df.select("embedding").mapInArrow(task, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[0] / w.n
    off = np.abs(total[1:] / w.n - np.outer(mean, mean) - np.diag(w.live.astype(float)))
    return float(off.max(initial=0))


def whiten(df: DataFrame, components: int = 8) -> DataFrame:
    """A row for each row of df (vec_id, embedding) that takes part and each of the first components."""
    df = df.select(F.col("vec_id").cast("bigint"), "embedding")
    bounded_batches(df.sparkSession)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(df)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    size, w = len(model.sums), Whitener(model, components)
    k = w.project.shape[1]
    error = identity_error(df, w, size)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = integers(b.column(1), size)
            rows = len(at) * k
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(rows, w.n)),
                    pa.array(w.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(w.whitened(x).ravel()),
                    pa.array(np.tile(w.explained, len(at))),
                    pa.array(np.full(rows, error)),
                ],
                schema=OUT,
            )

    return df.mapInArrow(task, schema)


def op12(df: DataFrame) -> DataFrame:
    """The first eight components of every row of embeddings that takes part."""
    return whiten(df, 8)

"""Vector search: matrix products of blocks, of which pivots rule out those that cannot reach the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import settled

SLACK = 1e-6  # radians, far above the rounding of an arc cosine
MOST_PIVOTS = 256
#: A block has at most so many numbers (32 MB of doubles), and a table is cut into about so many blocks before they grow to it.
BLOCK_NUMBERS = 1 << 22
FEW_BLOCKS = 8
SCORES = 1 << 23  # scores of one step of a product: 64 MB


def unit_rows(lists: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Arrays as rows of length one; shorter ones count as continued by zeros, null entries as zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), size))
    out[np.arange(size)[None, :] < lengths[:, None]] = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, n, out=out, where=n > 0)


def pivots_of(data: DataFrame, size: int, many: int) -> np.ndarray:
    """Up to `many` different directions of data, those of the least hashes of ids."""
    found = data.orderBy(F.xxhash64("id"), "id").limit(many).select("embedding").toArrow()["embedding"]
    rows = np.unique(unit_rows(found, size), axis=0)
    return rows[(rows != 0).any(axis=1)]


def in_cells(data: DataFrame, pivots: np.ndarray) -> DataFrame:
    """data with the nearest pivot (cell) and the angle to it."""
    size = pivots.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = unit_rows(b.column("embedding"), size) @ pivots.T
            cell = c.argmax(axis=1)
            angle = np.arccos(np.clip(c[np.arange(len(c)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    return data.mapInArrow(task, data.schema.simpleString()[len("struct<") : -1] + ",cell:int,angle:double")


def with_reach(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, threshold: float) -> DataFrame:
    """queries with the cells that may hold a vector over the threshold: the angle to the pivot less the cell's radius is small enough."""
    size, most = pivots.shape[1], np.arccos(np.clip(threshold, -1, 1)) + SLACK

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle = np.arccos(np.clip(unit_rows(b.column("embedding"), size) @ pivots.T, -1, 1))
            near = angle - radius[None, :] <= most
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.flatnonzero(r).astype(np.int32) for r in near], pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    return queries.mapInArrow(task, queries.schema.simpleString()[len("struct<") : -1] + ",cells:array<int>")


def block_rows(n: int, size: int, least: int) -> int:
    """Rows of a block of n vectors: copies of the data grow with the number of blocks, so there are few of them, bounded in memory."""
    return max(least, min(-(-n // FEW_BLOCKS), BLOCK_NUMBERS // size))


#: Rows of a group whose pairs are judged at once, and rows of groups that come into one task together.
GROUP_ROWS = 2048
BUCKET_ROWS = 16384


def best_before(rows: DataFrame, k: int, threshold: float, size: int, buckets: int) -> DataFrame:
    """(query, id, score): per row that asks the k best of the rows of its group before it, with a cosine over the threshold.

    rows (id, by, at, asks, embedding): in a group those that do not ask come first, then by time and id. Only rows of a
    group are multiplied, groups of equal numbers of rows together; a group is held by one task, so it should be small.
    """

    def best(t: pa.Table) -> pa.Table:
        ids, asks = t["id"].to_numpy(), t["asks"].to_numpy()
        at = t["at"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        codes = np.unique(t["by"].to_numpy().astype(str), return_inverse=True)[1]
        order = np.lexsort((ids, at, asks, codes))
        ids, asks, v = ids[order], asks[order], unit_rows(t["embedding"], size)[order]
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        counts = np.diff(starts, append=len(ids))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for c in np.unique(counts[counts > 1]):
            first, earlier = starts[counts == c], np.tri(c, k=-1, dtype=bool)
            step = max(1, SCORES // (c * max(c, size)))
            for i in range(0, len(first), step):
                at_ = first[i : i + step, None] + np.arange(c)
                x = v[at_]
                s = np.clip(x @ x.transpose(0, 2, 1), -1, 1)
                g, q, d = np.nonzero((s > threshold) & earlier & asks[at_][:, :, None])
                found.append((at_[g, q], at_[g, d], s[g, q, d]))
        query, near, score = map(np.concatenate, zip(*found))
        order = np.lexsort((ids[near], -np.round(score, 12), query))
        query, near, score = query[order], near[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        query, near, score = (x[place < k] for x in (query, near, score))
        return pa.table({"query": pa.array(ids[query], pa.int64()), "id": pa.array(ids[near], pa.int64()), "score": pa.array(score, pa.float64())})

    bucket = F.pmod(F.xxhash64("by"), F.lit(buckets)).cast("int")
    return rows.select("id", "by", "at", "asks", "embedding", bucket.alias("bucket")).groupBy("bucket").applyInArrow(best, "query bigint, id bigint, score double")


def similar(queries: DataFrame, data: DataFrame, k: int | None, threshold: float, block: int = 2048, pairs: bool = False, by: str | None = None) -> DataFrame:
    """(query, id, score): per query the k best of data with a cosine over the threshold, itself left out.

    Tables have (id, embedding[, by]); by: only rows of one value meet. Data of more than one block fall into the
    cells of up to 256 pivots; a query goes to the cells that the triangle inequality of angles leaves it, so nothing
    over the threshold is lost. Where queries keep more than half of the cells, these only copy them, and all is one
    cell. A cell's rows are cut into blocks by their ids, of `block` rows or more (see block_rows); a block of queries
    and one of data are one matrix product in one task, and only rows over the threshold (the block's k best of a query)
    leave it. pairs: queries are the data, each unordered pair once; rows then go to their own cell and greater ones
    only, in one cell to their own block and greater ones only.
    """
    group = F.col(by).cast("string") if by else F.lit("")
    shaped = lambda df: df.where("embedding IS NOT NULL AND size(embedding) > 0").select("id", "embedding", group.alias("by"))
    data_, asked = shaped(data), shaped(data if pairs else queries)
    if by:
        data_, asked = data_.where("by IS NOT NULL"), asked.where("by IS NOT NULL")
    sizes = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).head()
    n, size = sizes(data_)
    m, size_asked = (n, size) if pairs else sizes(asked)
    size = max(size, size_asked)
    pivots = pivots_of(data_, size, min(MOST_PIVOTS, 4 * (-(-n // block)))) if n > block and threshold >= 0 else np.zeros((0, size))
    celled = len(pivots) > 1
    if celled:
        placed = settled(in_cells(data_, pivots)) if pairs else in_cells(data_, pivots)
        radius = np.full(len(pivots), -np.inf)
        for r in placed.groupBy("cell").agg(F.max("angle").alias("angle")).collect():
            radius[r.cell] = r.angle
        reach = with_reach(placed.withColumnRenamed("cell", "own") if pairs else asked.withColumn("own", F.lit(-1)), pivots, radius, threshold)
        visits = reach.agg(F.sum(F.size("cells"))).head()[0] or 0
        celled = 2 * visits <= m * len(pivots)
    block = block_rows(n, size, block)
    buckets = -(-n // block) if by else 1
    if celled:
        data_, asked = placed, reach.withColumn("cells", F.filter("cells", lambda c: c >= F.col("own")))
    else:
        data_ = data_.withColumn("cell", F.lit(0))
        asked = asked.withColumns({"own": F.lit(0 if pairs else -1), "cells": F.array(F.lit(0))})
    key = F.pmod(F.xxhash64("by"), F.lit(buckets)).cast("int")
    right = data_.select("id", "embedding", "by", "cell", key.alias("bucket"))
    left = asked.select("id", "embedding", "by", "own", F.explode("cells").alias("cell"), key.alias("bucket"))
    count = lambda df, name: df.groupBy("cell", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    if n <= block:
        blocks = lambda df: df.withColumns({"of_data": F.lit(1), "of_asked": F.lit(max(1, -(-m // block)))})
    else:
        number = settled(count(right, "of_data").join(count(left, "of_asked"), ["cell", "bucket"]))
        blocks = lambda df: df.join(number, ["cell", "bucket"])
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    # the queries of pairs are the data, so their blocks in one cell are the same ones
    halved = pairs and not celled
    every = lambda first, last: F.explode(F.sequence(first, last))
    columns = ["id", "embedding", "by", "cell", "bucket"]
    left = blocks(left).withColumn("i", deal("of_asked"))
    left = left.select(*columns, "own", F.lit(0).alias("side"), "i", every(F.col("i") if halved else F.lit(0), F.col("of_data") - 1).alias("j"))
    right = blocks(right).withColumn("j", deal("of_data"))
    right = right.select(*columns, F.lit(-1).alias("own"), F.lit(1).alias("side"), "j", every(F.lit(0), F.col("j") if halved else F.col("of_asked") - 1).alias("i"))

    def product(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        a, b = (t.filter(pa.array(side == s)) for s in (0, 1))
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        va, vb = unit_rows(a["embedding"], size), unit_rows(b["embedding"], size).T
        codes = np.unique(np.concatenate([a["by"].to_numpy(), b["by"].to_numpy()]).astype(str), return_inverse=True)[1] if by else None
        inside = a["own"].to_numpy() == a["cell"].to_numpy()
        if halved and len(t) and t["i"][0].as_py() < t["j"][0].as_py():
            inside[:] = False
        out = []
        step = max(1, SCORES // max(1, len(ib)))
        for at in range(0, len(ia), step):
            own = ia[at : at + step]
            s = np.clip(va[at : at + step] @ vb, -1, 1)
            ok = s > threshold
            if by:
                ok &= codes[at : at + len(own), None] == codes[None, len(ia) :]
            if pairs:
                ok &= np.where(inside[at : at + step, None], ib[None, :] > own[:, None], ib[None, :] != own[:, None])
            else:
                ok &= own[:, None] != ib[None, :]
            if k is not None:
                for r in np.flatnonzero(ok.sum(axis=1) > k):
                    hit = np.flatnonzero(ok[r])
                    ok[r] = False
                    ok[r, hit[np.lexsort((ib[hit], -s[r, hit]))[:k]]] = True
            x, y = np.nonzero(ok)
            first, second = (np.minimum(own[x], ib[y]), np.maximum(own[x], ib[y])) if pairs else (own[x], ib[y])
            out.append(pa.table({"query": pa.array(first, pa.int64()), "id": pa.array(second, pa.int64()), "score": pa.array(s[x, y], pa.float64())}))
        return pa.concat_tables(out) if out else pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right).repartition(tasks, "cell", "bucket", "i", "j")
    found = both.groupBy("cell", "bucket", "i", "j").applyInArrow(product, "query bigint, id bigint, score double")
    if k is None:
        return found
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")

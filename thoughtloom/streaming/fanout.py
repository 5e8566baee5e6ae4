"""What a saved decision brings with it: edges to what is stored, derived batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import BatchTable, lean, parts_for, settled
from ..operators.rules import rejected_candidates
from ..operators.vectors import BUCKET_ROWS, GROUP_ROWS, best_before, similar

DECISION = "id bigint, user_id bigint, project_name string, created_at timestamp_ntz, turn_index int, agent_decision string, options array<string>, files array<string>, entities array<bigint>, embedding array<float>"
TABLES = {
    "decisions": DECISION,
    "candidates": "id string, decision_id bigint, text string",
    "similar": "src bigint, dst bigint, score double, tier string",
    "influenced": "src bigint, dst bigint, shared bigint",
    "temporal": "src bigint, dst bigint, rel string",
    "affects": "src bigint, dst string, confidence double",
    "reviews": "id bigint, other bigint, rank int",
    "pools": "project_name string, rows array<struct<at:timestamp_ntz,id:bigint,user_id:bigint>>",
}
#: Decisions of one project that a task reviews.
REVIEW_ROWS = 65_536


class SavedDecisions:
    """Tables of decisions and of the edges that their saving derives; save() is a foreachBatch function.

    A batch meets only batches with lesser numbers and writes its own folder of every table, so a batch that a restart
    runs again replaces what it had written. Decisions of a batch count as saved in the order of time, then id; a
    decision whose id is already stored is left out. Batches cut in order of time give the same edges as one batch.
    A batch's decisions are written once and read from their table; tables whose rows meet by vectors or by lists of
    entities are made in parts, one after the other, and no shuffle file nor settled table outlives what it was for.

    * candidates: options that were not chosen; affects: files of tool calls, with confidence 1.
    * similar: per decision its 5 best of the user's decisions saved before it.
    * influenced: pairs that share two entities or more, from the newer to the older.
    * temporal: FOLLOWS and PRECEDES between different turns of a user and project.
    * reviews: per decision the newest 20 that other users had saved in its project. Each project keeps a pool for
      this: its newest 40 decisions of which at most 20 are of one user hold the newest 20 of all but any one user.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.85, high: float = 0.90, k: int = 5, min_shared: int = 2, newest: int = 20):
        self.spark, self.path = spark, path
        self.threshold, self.high, self.k, self.min_shared, self.newest = threshold, high, k, min_shared, newest
        self.tables = {name: BatchTable(spark, f"{path}/{name}", schema) for name, schema in TABLES.items()}
        self.done = BatchTable(spark, f"{path}/done", "decisions bigint")

    def read(self, name: str) -> DataFrame:
        """A table without batches that are still being written."""
        return self.tables[name].read().join(F.broadcast(self.done.read().select("batch")), "batch", "left_semi").drop("batch")

    def save(self, batch: DataFrame, number: int) -> None:
        with lean(self.spark, batch.sparkSession):
            self._save(batch, number)

    def _save(self, batch: DataFrame, number: int) -> None:
        table = self.tables
        stored = table["decisions"].read(number).drop("batch")
        names = [c.split()[0] for c in DECISION.split(", ")]
        once = batch.select(*names).where("id IS NOT NULL").dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")
        table["decisions"].write(once.select(*names), number)
        new = self.spark.read.schema(DECISION).parquet(f"{self.path}/decisions/batch={number}")
        table["candidates"].write(rejected_candidates(new), number)
        # ids are unique, so a row's own files are all that can repeat
        table["affects"].write(new.select(F.col("id").alias("src"), F.explode(F.array_distinct("files")).alias("dst"), F.lit(1.0).alias("confidence")), number)
        table["similar"].write_parts(self._similar(new, stored), number)
        ranked = self._ranked(new, stored)
        row = F.size("all").cast("bigint")
        parts = parts_for(ranked.agg(F.sum(2 * (row - (self.min_shared - 1)) * (64 + 8 * row))).head()[0])
        table["influenced"].write_parts((self._met(ranked, i, parts) for i in range(parts)), number)
        table["temporal"].write(self._temporal(new, stored), number)
        reviews, pools = self._reviews(new, number)
        table["reviews"].write(reviews, number)
        table["pools"].write(pools, number)
        self.done.write(new.agg(F.count(F.lit(1)).alias("decisions")), number)

    def _similar(self, new: DataFrame, stored: DataFrame) -> Iterator[DataFrame]:
        """Parts by user; users of few decisions meet in one task, those of many in blocks."""
        shape = lambda d, asks: d.where("user_id IS NOT NULL AND size(embedding) > 0").select("id", F.col("user_id").alias("by"), F.col("created_at").alias("at"), F.lit(asks).alias("asks"), "embedding")
        rows = shape(stored, False).unionByName(shape(new, True))
        n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).head()
        many = settled(rows.groupBy("by").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS).select("by"))
        few = rows.join(many, "by", "left_anti") if (large := many.head() is not None) else rows
        parts = parts_for(n * (64 + 4 * size))
        named = lambda best: best.select(F.col("query").alias("src"), F.col("id").alias("dst"), "score", F.when(F.col("score") >= self.high, "high").otherwise("moderate").alias("tier"))
        for i in range(parts):
            part = few.where(F.pmod(F.xxhash64("by", F.lit(parts)), F.lit(parts)) == i)
            yield named(best_before(part, self.k, self.threshold, size, -(-n // (parts * BUCKET_ROWS)) or 1))
        if large:
            # for a group that one task should not hold, pairs over the threshold are ordered afterwards
            most = rows.join(many, "by", "left_semi")
            pairs = similar(most.where("asks"), most, None, self.threshold, by="by")
            end = lambda name: most.select(F.col("id").alias(name), F.struct("asks", "at", F.col("id").alias("x")).alias(f"at_{name}"))
            before = pairs.join(end("query"), "query").join(end("id"), "id").where("at_id < at_query")
            place = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id")
            yield named(before.withColumn("r", F.row_number().over(place)).where(F.col("r") <= self.k))

    def _ranked(self, new: DataFrame, stored: DataFrame) -> DataFrame:
        """(src, created_at, new, all): decisions of min_shared entities or more, and these, the rarest first."""
        both = stored.select("id", "created_at", "entities", F.lit(False).alias("new")).unionByName(new.select("id", "created_at", "entities", F.lit(True).alias("new")))
        rows = both.select(F.col("id").alias("src"), F.explode(F.array_distinct("entities")).alias("dst")).where("dst IS NOT NULL")
        degree = settled(rows.groupBy("dst").agg(F.count(F.lit(1)).alias("degree")))
        parts = parts_for(degree.agg(F.sum(96 * F.col("degree"))).head()[0])

        def lists(part: int) -> DataFrame:
            own = F.pmod(F.xxhash64("src", F.lit(parts)), F.lit(parts)) == part
            # dealt before they are grouped, so rows are shuffled and not lists of one
            x = rows.where(own).join(degree, "dst").repartition("src").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("degree", "dst"))).alias("x"))
            x = x.where(F.size("x") >= self.min_shared).select("src", F.transform("x", lambda e: e["dst"]).alias("all"))
            return x.join(both.select(F.col("id").alias("src"), "created_at", "new").where(own), "src").select("src", "created_at", "new", "all")

        return settled(*map(lists, range(parts)))

    def _met(self, ranked: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
        """Pairs that share min_shared entities, met in all but their min_shared - 1 most frequent ones; of one part of the entities."""
        few = F.slice("all", F.lit(1), F.size("all") - (self.min_shared - 1))
        index = ranked.select(F.explode(few).alias("dst"), "src", "created_at", "new", "all")
        index = index.where(F.pmod(F.xxhash64("dst", F.lit(parts)), F.lit(parts)) == part)
        # a pair is judged where the rarest of its shared entities is met, so the pairs that met are not grouped
        met = index.where("new").toDF("entity", "a", "at_a", "new_a", "of_a").join(index.toDF("entity", "b", "at_b", "new_b", "of_b").hint("merge"), "entity").where("(NOT new_b OR a < b) AND at_a <> at_b")
        met = met.withColumn("common", F.array_intersect("of_a", "of_b")).where((F.size("common") >= self.min_shared) & (F.get("common", F.lit(0)) == F.col("entity")))
        shared = met.select("a", "b", "at_a", "at_b", F.size("common").cast("bigint").alias("shared"))
        newer = F.col("at_a") > F.col("at_b")
        return shared.select(F.when(newer, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(newer, F.col("b")).otherwise(F.col("a")).alias("dst"), "shared")

    def _influenced(self, new: DataFrame, stored: DataFrame) -> DataFrame:
        return self._met(self._ranked(new, stored))

    def _temporal(self, new: DataFrame, stored: DataFrame) -> DataFrame:
        turns = lambda d, end, fresh: d.where("turn_index IS NOT NULL").select(F.col("id").alias(end), "user_id", "project_name", F.col("turn_index").alias(f"turn_{end}"), F.lit(fresh).alias(f"new_{end}"))
        every = turns(stored, "b", False).unionByName(turns(new, "b", True))
        met = turns(new, "a", True).join(every, ["user_id", "project_name"]).where("turn_a > turn_b OR (turn_a < turn_b AND NOT new_b)")
        later = F.col("turn_a") > F.col("turn_b")
        first, last = F.when(later, F.col("b")).otherwise(F.col("a")), F.when(later, F.col("a")).otherwise(F.col("b"))
        ends = F.array(F.struct(last.alias("src"), first.alias("dst"), F.lit("FOLLOWS").alias("rel")), F.struct(first.alias("src"), last.alias("dst"), F.lit("PRECEDES").alias("rel")))
        return met.select(F.explode(ends).alias("e")).select("e.*")

    def _reviews(self, new: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """(reviews, pools): a project's new decisions in stretches of time, each of which starts from the pool that those before leave.

        The pool after a stretch is that of the pool before it and of the stretch's own pool, so all own pools are made
        at once, joined in order, and then all stretches are reviewed at once.
        """
        n, least = self.newest, np.iinfo(np.int64).min
        last = Window.partitionBy("project_name").orderBy(F.desc("batch"))
        pools = self.tables["pools"].read(number).withColumn("r", F.row_number().over(last)).where("r = 1")
        pools = pools.select("project_name", F.explode("rows").alias("x")).select("project_name", F.col("x.at").alias("at"), "x.id", "x.user_id", F.lit(-1).alias("stretch"))
        mine = new.where("user_id IS NOT NULL AND project_name IS NOT NULL").select("project_name", F.col("created_at").alias("at"), "id", "user_id")
        many = -(-mine.count() // REVIEW_ROWS) or 1
        mine = settled(mine.repartitionByRange(many, "project_name", "at", "id").withColumn("stretch", F.spark_partition_id()))

        def rows_of(t: pa.Table) -> list[tuple]:
            """(stretch, at, id, user) in this order, without time first."""
            at = t["at"].cast(pa.int64()).fill_null(least)
            return sorted(zip(*(x.to_pylist() for x in (t["stretch"], at, t["id"], t["user_id"]))))

        def add(pool: list[tuple], row: tuple) -> None:
            """pool: (stretch, at, id, user), the newest first."""
            i = next((i for i, x in enumerate(pool) if x[1:3] < row[1:3]), len(pool))
            pool.insert(i, row)
            own = [i for i, x in enumerate(pool) if x[3] == row[3]]
            if len(own) > n:
                del pool[own[-1]]
            del pool[2 * n :]

        def table(project: str, rows: list[tuple]) -> pa.Table:
            at = pa.array([None if r[1] == least else r[1] for r in rows], pa.int64()).cast(pa.timestamp("us"))
            ints = lambda i, kind: pa.array([r[i] for r in rows], kind)
            return pa.table({"project_name": pa.array([project] * len(rows), pa.string()), "stretch": ints(0, pa.int32()), "at": at, "id": ints(2, pa.int64()), "user_id": ints(3, pa.int64())})

        def own_pool(t: pa.Table) -> pa.Table:
            pool, users = [], {}
            rows = rows_of(t)
            for row in reversed(rows):
                if users.setdefault(row[3], 0) < n:
                    users[row[3]] += 1
                    pool.append(row)
                    if len(pool) == 2 * n:
                        break
            return table(t["project_name"][0].as_py(), pool)

        def joined(t: pa.Table) -> pa.Table:
            """The pool before each stretch, and without a number that after the last."""
            pool, out, at = [], [], None
            for row in rows_of(t):
                if at is not None and row[0] > at:
                    out += [(row[0], *x[1:]) for x in pool]
                at = row[0]
                add(pool, row)
            return table(t["project_name"][0].as_py(), out + [(None, *x[1:]) for x in pool])

        def reviewed(t: pa.Table) -> pa.Table:
            pool: list[tuple] = []
            for x in rows_of(t.filter(pa.compute.invert(t["fresh"]))):
                add(pool, x)
            ids, others, many = [], [], []
            for row in rows_of(t.filter(t["fresh"])):
                found = [x[2] for x in pool if x[3] != row[3]][:n]
                ids.append(row[2])
                many.append(len(found))
                others += found
                add(pool, row)
            many = np.array(many, np.int64)
            rank = np.arange(len(others)) - np.repeat(np.cumsum(many) - many, many) + 1
            return pa.table({"id": pa.array(np.repeat(np.array(ids, np.int64), many)), "other": pa.array(others, pa.int64()), "rank": pa.array(rank.astype(np.int32))})

        shape = "project_name string, stretch int, at timestamp_ntz, id bigint, user_id bigint"
        own = mine.groupBy("project_name", "stretch").applyInArrow(own_pool, shape)
        before = pools.join(mine.select("project_name").distinct(), "project_name", "left_semi").unionByName(own)
        before = settled(before.groupBy("project_name").applyInArrow(joined, shape))
        fresh = mine.withColumn("fresh", F.lit(True)).unionByName(before.where("stretch IS NOT NULL").withColumn("fresh", F.lit(False)))
        reviews = fresh.groupBy("project_name", "stretch").applyInArrow(reviewed, "id bigint, other bigint, rank int")
        return reviews, before.where("stretch IS NULL").groupBy("project_name").agg(F.collect_list(F.struct("at", "id", "user_id")).alias("rows"))

"""Stateful and incremental mechanisms against whole runs and brute force."""

import datetime as dt
import json
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from thoughtloom.functions import tables
from thoughtloom.functions.tables import BatchTable
from thoughtloom.operators import text_index, vectors
from thoughtloom.operators import containment, extraction, graph, integrity, metrics, resolve, rules
from thoughtloom.operators import search as S
from thoughtloom.plans.registry import queries
from thoughtloom.sources import sinks, transcripts
from thoughtloom.streaming import fanout, queue, registry
from thoughtloom.streaming import streams as W


def brute_cosine(rows, threshold, asked=None):
    unit = {i: np.array(v, float) / (np.linalg.norm(v) or 1) for i, v, *_ in rows}
    return {(a, b): float(unit[a] @ unit[b]) for a in (asked or unit) for b in unit if a != b and float(unit[a] @ unit[b]) > threshold}


@pytest.mark.parametrize("threshold", [-0.1, 0.2, 0.6])
def test_pruned_products_lose_nothing(spark, threshold):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in middle[i % 12] * (i % 7 > 0) + rng.normal(size=8) * 0.3], i % 3) for i in range(300)]
    rows += [(300 + i, rows[5][1], 1) for i in range(60)]  # a hot vector
    df = spark.createDataFrame(rows + [(999, None, 1), (998, [], 1)], "id bigint, embedding array<double>, user_id int")
    want = brute_cosine(rows, threshold)
    got = {(r.query, r.id): r.score for r in vectors.similar(df, df, None, threshold, block=25).collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    pairs = [(r.query, r.id) for r in vectors.similar(df, df, None, threshold, block=25, pairs=True).collect()]
    assert sorted(pairs) == sorted(p for p in want if p[0] < p[1])
    user = {r[0]: r[2] for r in rows}
    own = {(r.query, r.id) for r in vectors.similar(df, df, None, threshold, block=25, by="user_id").collect()}
    assert own == {p for p in want if user[p[0]] == user[p[1]]}
    best = {}
    for r in vectors.similar(df.where("id % 20 = 0"), df, 4, threshold, block=25).collect():
        best.setdefault(r.query, []).append(r.id)
    for q in range(0, 360, 20):
        first = sorted((-round(s, 12), b) for (a, b), s in want.items() if a == q)[:4]
        assert sorted(round(want[q, b], 9) for b in best.get(q, [])) == sorted(round(-s, 9) for s, _ in first)


def test_pivots_skip_most_pairs_of_clusters(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 32))
    rows = [(i, [float(x) for x in middle[i % 40] + rng.normal(size=32) * 0.08]) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    pivots = vectors.pivots_of(df, 32, 160)
    cells = vectors.in_cells(df, pivots)
    size, radius = np.zeros(len(pivots)), np.full(len(pivots), -np.inf)
    for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect():
        size[r.cell], radius[r.cell] = r.n, r.angle
    reached = vectors.with_reach(df, pivots, radius, 0.9).select("cells").collect()
    met = sum(size[c] for r in reached for c in r.cells)
    assert met < 0.15 * 2000 * 2000


def test_vectors_without_clusters_are_copied_to_few_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    dealt, kind = [], type(df)
    before = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: dealt.append(before(self, *a)) or dealt[-1])
    for pairs in (False, True):
        got = {(r.query, r.id) for r in vectors.similar(df, df, None, 0.5, block=25, pairs=pairs).collect()}
        assert got == {p for p in brute_cosine(rows, 0.5) if not pairs or p[0] < p[1]}
        assert dealt.pop().count() <= 2 * 2000 * vectors.FEW_BLOCKS
    # blocks stay bounded in memory at any size
    assert vectors.block_rows(10**9, 64, 2048) * 64 <= vectors.BLOCK_NUMBERS


# ---- the stored text index


def test_stored_index_grows_and_replays(spark, tmp_path):
    index = text_index.TextIndex(spark, f"file://{tmp_path}/index", ["a", "b"], buckets=4)
    docs = lambda rows: spark.createDataFrame(rows, "id bigint, a string, b string")
    first, second = [(1, "Redis cache", "fast"), (2, None, None), (3, "cache cache", "Postgres")], [(4, "redis", "again, Redis"), (5, "prefixredis", "")]
    asked = spark.createDataFrame([(1, "redis cache"), (2, "efixre"), (3, "nothing"), (4, "")], "id bigint, text string")
    whole = lambda rows: sorted((r.query, r.id, round(r.score, 9)) for r in S.fulltext_search(asked, docs(rows).select("id", F.concat_ws("\n", "a", "b").alias("text"))).collect())
    ranked = lambda terms=None: sorted((r.query, r.id, round(r.score, 9)) for r in text_index.rank(asked, index.read(terms)).collect())
    index.add(docs(first), 0)
    assert ranked() == [x for x in whole(first)]
    index.add(docs(second), 1)
    index.add(docs(second), 1)
    assert ranked() == [x for x in whole(first + second) if x[0] == 1]
    assert ranked(asked.select(F.explode(text_index.words_of("text")).alias("term"))) == ranked()
    both = S.search_kinds(asked, index, index).collect()
    assert sorted((r.query, r.id, round(r.score, 9)) for r in both if r.kind == "entity") == whole(first + second)
    assert (2, 5, 1.0) in whole(first + second) and len(both) == 2 * len(whole(first + second))


# ---- saving decisions batch by batch


def saved_rows(n=240, seed=2):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    middle = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        at = start + dt.timedelta(minutes=i // 2)
        vector = None if i % 11 == 0 else [x + rng.gauss(0, 0.25) for x in middle[rng.randrange(5)]]
        options = ["use a", "use b", "no"] if i % 3 else None
        rows.append((i, rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice(["p", "p", "q", None]), at, rng.choice([None, 0, 1, 2]), "use a", options, [f"f{i % 9}"], [rng.randrange(30) for _ in range(4)], vector))
    return rows


def brute_reviews(rows):
    out = []
    for i, user, project, at, *_ in rows:
        if user is not None and project is not None:
            others = sorted(((r[3], r[0]) for r in rows if r[2] == project and r[1] not in (None, user) and (r[3], r[0]) < (at, i)), reverse=True)
            out += [(i, o, k) for k, (_, o) in enumerate(others[:20], 1)]
    return sorted(out)


def test_saving_in_batches_equals_one_batch_and_survives_a_restart(spark, tmp_path, monkeypatch):
    rows = saved_rows()
    df = spark.createDataFrame(rows, fanout.DECISION)
    state = lambda store: {name: sorted(map(str, store.read(name).collect())) for name in fanout.TABLES if name != "pools"}
    whole = fanout.SavedDecisions(spark, f"file://{tmp_path}/whole")
    whole.save(df, 0)
    want = state(whole)
    assert all(want.values())
    assert sorted((r.id, r.other, r.rank) for r in whole.read("reviews").collect()) == brute_reviews(rows)

    for i in range(3):
        df.where(f"id >= {80 * i - (5 if i else 0)} AND id < {80 * (i + 1)}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # batches overlap by saved ids
        (tmp_path / "in").joinpath("_SUCCESS").unlink(missing_ok=True)
    store = fanout.SavedDecisions(spark, f"file://{tmp_path}/store")
    write, broken = BatchTable.write, [True]

    def failing(self, found, number):
        if number == 1 and self.path.endswith("temporal") and broken.pop():
            raise OSError("lost")
        write(self, found, number)

    monkeypatch.setattr(BatchTable, "write", failing)

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(store.save).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    half = state(store)
    assert len(half["decisions"]) == 80
    broken.append(False)
    run()
    assert state(store) == want
    store.save(df.where("id >= 155"), 2)
    assert state(store) == want


# ---- the queue of messages


def test_queue_by_size_time_and_request_with_a_failing_sink(spark, tmp_path):
    for name, schema in (("messages", queue.MESSAGE), ("requests", "session bigint")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    send = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    stored, log, calls = {}, [], []

    def write(rows, epoch):
        found = [tuple(r) for r in rows.collect()]
        calls.append(epoch)
        log.extend((s, b) for s, b, *_ in found)
        if len(calls) == 1:
            raise OSError("the store is away")
        bad = {(s, b) for s, b, *_ in found if s == 2 and len(calls) == 2}
        for s, b, i, role, content in found:
            if (s, b) not in bad:
                assert (s, i) not in stored
                stored[s, i] = (b, role, content)
        return spark.createDataFrame(sorted(bad), "session bigint, batch bigint") if bad else None

    sink = queue.Deliveries(spark, f"{tmp_path}/back", write)
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    heard = queue.queued(read("messages", queue.MESSAGE), read("requests", "session bigint"), sink.returned())
    want = {(s, i): f"text {i}" for s, n in ((1, 23), (2, 12), (3, 4)) for i in range(n)}
    send("messages", [(s, i, "user", t) for (s, i), t in want.items()], queue.MESSAGE)
    q = queue.flushes(heard, 10, 3_000).writeStream.foreachBatch(sink.save).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    end = time.time() + 150
    asked = False
    while len(stored) < len(want) and time.time() < end and q.exception() is None:
        if not asked and len(calls) >= 1:
            send("requests", [(3,)], "session bigint")
            asked = True
        time.sleep(0.3)
    time.sleep(4)  # nothing comes twice
    q.stop()
    assert q.exception() is None
    assert {k: v[2] for k, v in stored.items()} == want
    for s in (1, 2, 3):
        numbers = list(dict.fromkeys(b for t, b in log if t == s))
        assert numbers == sorted(numbers) and numbers == list(range(len(numbers)))
        sizes = {}
        for (t, _), (b, *_rest) in stored.items():
            if t == s:
                sizes[b] = sizes.get(b, 0) + 1
        assert max(sizes.values()) <= 10


# ---- files once, lines of files of any size


def transcript(i, n):
    rows = [{"type": "user" if k % 2 == 0 else "assistant", "message": {"role": "user" if k % 2 == 0 else "assistant", "content": f"é {i} {k} " + "x" * (k % 50)}} for k in range(n)]
    rows.insert(n // 2, {"type": "conversation_end"})
    return "\n".join(map(json.dumps, rows)) + "\n\nnot json\n"


def test_lines_are_numbered_across_splits(spark, tmp_path):
    texts = {"a": transcript(1, 200), "b": transcript(2, 3), "c": "", "d": "\n\nno newline at the end"}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.jsonl").write_text(text)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = transcripts.numbered_lines(spark, f"file://{tmp_path}")
        assert got.rdd.getNumPartitions() > 4
        found = {}
        for r in got.collect():
            found.setdefault(r.file_path.rsplit("/", 1)[-1][0], {})[r.line] = r.raw
        hashes = {r.file_path.rsplit("/", 1)[-1][0]: r.hash for r in transcripts.content_hashes(got, 7).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in texts.items():
        lines = text.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert found.get(name, {}) == dict(enumerate(lines))
    assert len(set(hashes.values())) == len(hashes) == 3
    again = {r.file_path.rsplit("/", 1)[-1][0]: r.hash for r in transcripts.content_hashes(transcripts.numbered_lines(spark, f"file://{tmp_path}"), 7).collect()}
    assert again == hashes


def test_a_file_is_taken_once_for_ever(spark, tmp_path):
    ledger, seen = registry.FileLedger(spark, f"file://{tmp_path}/ledger"), []
    write = lambda df, n: seen.extend((n, r.file_path.rsplit("/", 1)[-1], r.conversation, r.turn_index) for r in df.collect())
    (tmp_path / "in").mkdir()
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)

    def run():
        lines = W.stream_lines(spark, f"file://{tmp_path}/in")
        lines.writeStream.foreachBatch(ledger.on_batch(write)).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination()

    put("a.jsonl", transcript(1, 4))
    put("copy.jsonl", transcript(1, 4))
    put("none.jsonl", "not json\n")
    run()
    assert sorted(seen) == [(0, "a.jsonl", c, t) for c in (0, 1) for t in (0, 1)]
    # days later: the content under another name stays out, a file that gave nothing is judged again, a new one comes in
    put("later.jsonl", transcript(1, 4))
    put("none2.jsonl", "not json\n")
    put("b.jsonl", transcript(2, 2))
    run()
    assert sorted(x for x in seen if x[0] == 1) == [(1, "b.jsonl", 0, 0), (1, "b.jsonl", 1, 0)]
    rows = [(r.path.rsplit("/", 1)[-1], r.conversations, r.batch) for r in ledger.table.read().collect()]
    assert sorted(rows) == [("a.jsonl", 2, 0), ("b.jsonl", 2, 1)]
    # the same batch again changes nothing
    ledger.process(transcripts.numbered_lines(spark, [f"file://{tmp_path}/in/{n}" for n in ("b.jsonl", "later.jsonl")]), 1, write)
    assert sorted((r.path.rsplit("/", 1)[-1], r.batch) for r in ledger.table.read().collect()) == [("a.jsonl", 0), ("b.jsonl", 1)]


def test_held_alert_on_a_stream_equals_the_table(spark, tmp_path):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=6 * i), rng.random() < (0.5 if 200 <= i < 420 or 600 <= i < 640 else 0.01)) for i in range(1000)]
    schema = "ts timestamp, failed boolean"
    df = spark.createDataFrame(rows, schema)
    for k in range(4):
        spark.createDataFrame(rows[250 * k : 250 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(start + dt.timedelta(days=1), False)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    held = W.held_stream(W.error_rate(stream, F.col("failed"), threshold=0.2))
    q = held.writeStream.format("memory").queryName("held_alerts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(240)
    want = sorted(tuple(r) for r in W.held(W.error_rate(df, F.col("failed"), threshold=0.2)).collect())
    got = sorted((r.start, r.end) for r in spark.table("held_alerts").collect())
    assert want and got == want


# ---- cycles, overlaps, containment


def brute_cycles(edges, depth):
    out = {}
    step = {}
    for a, b in set(edges):
        if a != b:
            step.setdefault(a, []).append(b)

    def walk(path):
        for b in step.get(path[-1], []):
            if b == path[0] and len(path) > 1:
                key = tuple(sorted(path))
                out[key] = min(out.get(key, tuple(path)), tuple(path))
            elif b > path[0] and b not in path and len(path) < depth:
                walk([*path, b])

    for a in step:
        walk([a])
    return {(nodes, len(nodes)) for nodes in out.values()}


def test_cycles_of_every_depth_equal_brute_force(spark):
    rng = random.Random(8)
    ring = [(i, (i + 1) % 20) for i in range(20)]  # a cycle of 20 with chords
    chords = [(rng.randrange(20), rng.randrange(20)) for _ in range(6)]
    apart = [(100 + a, 100 + b) for a, b in [(0, 1), (1, 2), (2, 3), (3, 0), (2, 0), (4, 5)]] + [(7, 107), (107, 108), (108, 9), (30, 30)]
    edges = ring + chords + apart
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    for depth in (4, 20):
        want = brute_cycles(edges, depth)
        got = {(tuple(r.nodes), r.length) for r in integrity.find_cycles(df, depth, None).collect()}
        assert got == want
    assert any(n == 20 for _, n in want) and len({n for _, n in want}) > 5


def test_cycles_of_small_components_are_found_without_walks(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(10 * g + rng.randrange(6), 10 * g + rng.randrange(6)) for g in range(40) for _ in range(9)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    want = brute_cycles(edges, 5)
    found = lambda df, rest: {(tuple(r.nodes), r.length) for r in df.collect()} | brute_cycles([(r.src, r.dst) for r in rest.collect()], 5)
    small, rest = integrity._cycles_of_small(df.withColumn("rel", F.lit("")), 5, 6)
    assert small.count() and rest.count() and found(small, rest) == want
    monkeypatch.setattr(integrity, "cyclic_core", lambda *_: pytest.fail("walked"))
    assert found(integrity.find_cycles(df, 5, None), rest.limit(0)) == want and len(want) > 40


def test_components_settle_a_multiple_of_the_edges_once(spark, monkeypatch):
    rng = random.Random(6)
    ids = rng.sample(range(10**6), 600)
    edges = list(zip(ids[:300], ids[1:300])) + [(ids[300 + rng.randrange(300)], ids[300 + rng.randrange(300)]) for _ in range(150)] + [(ids[0], ids[0])]
    nodes = spark.createDataFrame([(i,) for i in [*ids, -5, -5]], "id bigint")
    sizes, settled = [], integrity.settled
    monkeypatch.setattr(integrity, "settled", lambda df: (lambda t: sizes.append(t.count()) or t)(settled(df)))
    got = {r.id: r.component for r in integrity.components(nodes, spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    want = {i: i for i in [*ids, -5]}
    for _ in range(600):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert sum(sizes) < 8 * len(edges)  # 20 times and more where every round settles all labels
    none = integrity.components(nodes.where("id = -5"), spark.createDataFrame([], "src bigint, dst bigint"))
    assert [tuple(r) for r in none.collect()] == [(-5, -5)]


def test_layers_between_two_cycles_are_not_walked(spark):
    """15 full layers of 6 nodes hold 6^15 walks from one 2-cycle to the other, and no cycle."""
    edges = [(0, 1), (1, 0), (900, 901), (901, 900)]
    layer = lambda k: [10 * k + j for j in range(1, 7)]
    edges += [(1, x) for x in layer(1)] + [(x, 900) for x in layer(15)]
    edges += [(x, y) for k in range(1, 15) for x in layer(k) for y in layer(k + 1)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    inside = integrity.strong_components(df.withColumn("rel", F.lit("")))
    assert sorted((r.src, r.dst) for r in inside.collect()) == [(0, 1), (1, 0), (900, 901), (901, 900)]
    assert sorted(tuple(r.nodes) for r in integrity.find_cycles(df, 20, None).collect()) == [(0, 1), (900, 901)]


def test_overlap_join_of_a_hub(spark):
    rng = random.Random(3)
    rows = sorted({(d, 0) for d in range(300) if d % 3} | {(d, rng.randrange(1, 200)) for d in range(300) for _ in range(5)} | {(d, 5 + d % 2) for d in range(6)})
    df = spark.createDataFrame(rows + rows[:50], "src bigint, dst bigint")
    own = {}
    for d, e in rows:
        own.setdefault(d, set()).add(e)
    for least in (1, 2, 3):
        want = {(a, b, len(own[a] & own[b])) for a in own for b in own if a < b and len(own[a] & own[b]) >= least}
        assert {tuple(r) for r in graph.shared_entity_pairs(df, least).collect()} == want
    met = graph.overlap_index(df.distinct(), 2).groupBy("dst").count().select(F.sum(F.col("count") * (F.col("count") - 1) / 2)).head()[0]
    everything = df.distinct().groupBy("dst").count().select(F.sum(F.col("count") * (F.col("count") - 1) / 2)).head()[0]
    assert met < 0.25 * everything


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc d") for _ in range(rng.randint(0, 7)))
    needles, texts = [(rng.randrange(3), word()) for _ in range(150)], [(rng.randrange(3), word() + word()) for _ in range(150)]
    got = containment.containing(spark.createDataFrame(needles, "g int, needle string"), spark.createDataFrame([*texts, (1, None)], "g int, text string"), ["g"])
    assert sorted(map(tuple, got.collect())) == sorted({(g, n, t) for g, n in needles for h, t in texts if g == h and n and n in t})


def test_dormant_alternatives_with_follows(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(1, 1, day(0), 0.5, "Use Redis"), (2, 1, day(5), 0.5, "KAFKA streams"), (3, 1, day(9), None, "no"), (4, 2, day(9), 0.5, "kafka"), (5, 1, day(1), 0.5, None), (6, 1, day(2), 0.5, "")]
    d = spark.createDataFrame(rows, "id bigint, user_id bigint, created_at timestamp_ntz, confidence double, agent_decision string")
    c = spark.createDataFrame([("a", 1, "Kafka"), ("b", 1, "no sql at all"), ("c", 1, "Pulsar"), ("d", 2, "kafka"), ("e", 2, "note")], "id string, decision_id bigint, text string")
    at = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    plain = {r.id for r in rules.dormant_alternatives(c, d, at).collect()}
    assert plain == {"c", "d"}
    follows = spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint")
    assert {r.id for r in rules.dormant_alternatives(c, d, at, follows=follows).collect()} == {"c", "d", "e"}
    plan = rules.dormant_alternatives(c, d, at)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Contains(chosen" not in plan


def test_budget_over_ranges(spark):
    rows = [(g, i, (i * 7) % 23) for g in (1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, i int, n int").repartition(6)
    got = sorted((r.g, r.i, r.spent) for r in rules.within_budget(df, ["g"], [F.col("i")], F.col("n") * 4, 1000).collect())
    want = []
    for g in (1, 2):
        spent = 0
        for i in range(500):
            spent += (i * 7) % 23
            if spent <= 1000:
                want.append((g, i, spent))
    assert got == want


def test_delete_project(spark):
    d = spark.createDataFrame([(1, 1, "p"), (2, 2, "p"), (3, 1, "q"), (4, 1, None)], "id bigint, user_id bigint, project_name string")
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id bigint, name string")
    rows = [(1, 1, "INVOLVES"), (2, 2, "INVOLVES"), (3, 2, "INVOLVES"), (4, 4, "INVOLVES"), (1, 2, "IS_A"), (2, 4, "IS_A"), (1, 3, "SIMILAR_TO"), (3, 4, "SIMILAR_TO"), (4, 2, "CONTRADICTS")]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, rel string")
    left, kept, still = integrity.delete_project(d, e, edges, "p", spark.createDataFrame([(3,)], "id bigint"))
    assert sorted(r.id for r in left.collect()) == [3, 4] and sorted(r.id for r in kept.collect()) == [2, 3, 4]
    assert sorted(map(tuple, still.collect())) == [(2, 4, "IS_A"), (3, 2, "INVOLVES"), (3, 4, "SIMILAR_TO"), (4, 4, "INVOLVES")]


# ---- notices, quotes, answers


def test_notices_of_the_other_kinds(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(1, 7, "Pick a store " + "x" * 80, "config", day(0), None), (2, 8, None, "config", day(50), None), (3, None, "t", "config", day(0), None)]
    d = spark.createDataFrame(rows, "id bigint, user_id bigint, trigger string, scope string, created_at timestamp_ntz, last_reviewed_at timestamp_ntz")
    (got,) = rules.notify_stale(d, F.lit("2024-02-20 00:00:00").cast("timestamp_ntz")).collect()
    assert (got.user_id, got.subject, got.title) == (7, "1", "Stale decision needs review") and json.loads(got.payload) == {"decision_id": 1, "scope": "config", "days_old": 50}
    assert got.text == f'Your config decision "{rows[0][2][:80]}" is 50 days old and may need to be reviewed or confirmed still relevant.'
    v = spark.createDataFrame([(1, "a" * 120, 2), (3, "b", 2)], "id bigint, assumption string, later_id bigint")
    (got,) = rules.notify_assumptions(v, d).collect()
    assert got.text == f'Your assumption "{"a" * 100}" in decision "{rows[0][2][:60]}" may be invalidated by a newer decision: "".'
    assert json.loads(got.payload) == {"decision_id": 1, "assumption": "a" * 120, "invalidating_decision_id": 2}
    c = spark.createDataFrame([("k", 2, "use kafka", 40, 0.25)], "id string, decision_id bigint, text string, days bigint, score double")
    (got,) = rules.notify_dormant(c, d).collect()
    assert (got.user_id, got.subject) == (8, "k") and got.text == 'Alternative "use kafka" from the decision "" has been dormant for 40 days and may now be viable.'
    assert json.loads(got.payload) == {"candidate_id": "k", "reconsider_score": 0.25, "days_dormant": 40}


def test_quotes_with_signs_of_patterns(spark):
    texts = ["see C:\\E(x now", "a.*b [c] $1 ^ \\Q | {2}", "plain  WORDS here"]
    quotes = [(i, i, q) for i, q in enumerate(["C:\\E(x", "A.*b  [c] $1 ^ \\Q | {2}", "words HERE"])] + [(3, 0, "c:\\e(y")]
    m = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id bigint, turn_index int, content string")
    got = {r.id: texts[r.id][r.start_char : r.end_char] for r in extraction.find_spans(spark.createDataFrame(quotes, "id bigint, conv_id bigint, quote string"), m).collect()}
    assert got == {0: "C:\\E(x", 1: texts[1], 2: "WORDS here"}


def test_answers_as_lists(spark):
    rows = [(1, '{"a": 1}'), (2, "text ```json\n[1]\n```"), (3, 'so: {"b": [2]}'), (4, "none"), (5, None)]
    got = {r.i: r.j for r in spark.createDataFrame(rows, "i int, t string").select("i", extraction.recover_json(F.col("t"), True).alias("j")).collect()}
    assert got == {1: '[{"a":1}]', 2: "[1]", 3: "[2]", 4: None, 5: None}


def _commits_and_decisions(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    made = [(i, t0 + timedelta(hours=7 * i)) for i in range(60)]
    affects = [(i, f) for i in range(60) for f in {i % 3, i % 5}]
    done = [(f"c{j}", t0 + timedelta(hours=11 * j), sorted({j % 2, j % 5, 7})) for j in range(40)]
    return made, affects, done


def test_decisions_of_commits_meet_in_slots_of_time(spark):
    from datetime import timedelta

    made, affects, done = _commits_and_decisions(spark)
    found = graph.link_decisions(spark.createDataFrame(made, "id long, created_at timestamp_ntz"), spark.createDataFrame(affects, "src long, dst long"), spark.createDataFrame(done, "sha string, committed_at timestamp_ntz, files_changed array<long>"), hours=48, threshold=0.3)
    want = {(sha, i, n) for sha, at, files in done for i, t in made if at - timedelta(hours=48) <= t <= at for n in [len({f for x, f in affects if x == i} & set(files))] if n / len(files) >= 0.3}
    assert {(r.sha, r.id, r.overlap) for r in found.collect()} == want and want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("slot" in x and "dst" in x for x in plan.splitlines() if "Join Inner" in x)


def test_exploded_runs_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(i % 5, f"ship {i}") for i in range(50)], "g int, needle string").write.parquet(f"{tmp_path}/needles")
    spark.createDataFrame([(i % 5, f"we ship {i} now") for i in range(50)] + [(1, "ok"), (2, "x")], "g int, text string").write.parquet(f"{tmp_path}/texts")
    found = containment.containing(spark.read.parquet(f"{tmp_path}/needles"), spark.read.parquet(f"{tmp_path}/texts"), ["g"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == sum(f"ship {i}" in f"we ship {j} now" for i in range(50) for j in range(i % 5, 50, 5))


@pytest.mark.parametrize("threshold", [0.0, 0.25, 0.5])
def test_commits_of_sessions_meet_on_files(spark, threshold):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rng = random.Random(2)
    files = lambda: [rng.choice([1, 2, 3, 4, 5, None]) for _ in range(rng.randint(0, 5))]
    sessions, commits = [(i, at(17 * i), files()) for i in range(50)], [(f"c{i}", at(13 * i), files()) for i in range(60)]
    found = graph.link_commits(spark.createDataFrame(sessions, "session bigint, ts timestamp_ntz, files array<int>"), spark.createDataFrame(commits, "sha string, committed_at timestamp_ntz, files_changed array<int>"), 2, threshold)
    score = lambda a, b: len(set(a) & set(b)) / (len(set(a) | set(b)) or 1)
    want = sorted((i, s, round(score(x, y), 9)) for i, t, x in sessions for s, u, y in commits if t <= u <= t + dt.timedelta(hours=2) and score(x, y) >= threshold)
    assert sorted((r.session, r.sha, round(r.score, 9)) for r in found.collect()) == want
    join = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert ("changed#" in join.replace("files_changed", "")) == (threshold > 0)


def test_json_rows_of_all_decisions(spark):
    d = spark.range(20_000).select("id", F.lit("F").alias("source"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("created_at"))
    e = spark.createDataFrame([(1, "a", "t")], "id bigint, name string, type string")
    i = spark.createDataFrame([(5, 1), (19_999, 1)], "src bigint, dst bigint")
    assert sinks.json_rows(d, e, i, "F", None).agg(F.count(F.lit(1)), F.sum(F.size("entities"))).head()[:] == (20_000, 2)
    assert sinks.json_rows(d, e, i, "F").count() == 10_000
    plan = queries()["snk1_json_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_quantiles_of_tables_are_exact(spark, p):
    start = dt.datetime(2024, 1, 1)
    one = spark.range(60_000).select(F.lit(start).cast("timestamp").alias("ts"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    two = spark.createDataFrame([(start + dt.timedelta(days=1), float(x)) for x in [3, 3, 3, 1, 9]] + [(start + dt.timedelta(days=2), None)], "ts timestamp, v double")
    both = one.unionByName(two)
    got = {r.start.day: r.quantile for r in W.latency_alert(both, "v", size="1 day", p=p).collect()}
    ranked = lambda x: sorted(x)[max(1, -(-len(x) * int(100 * p) // 100)) - 1]
    assert got == {1: ranked([r.v for r in one.collect()]), 2: ranked([3.0, 3.0, 3.0, 1.0, 9.0]), 3: None}


def test_relations_by_name_are_not_grouped_as_pairs(spark):
    rng = random.Random(8)
    e = [(i, rng.choice("AbCd"), [rng.choice("abxy")] if i % 5 == 0 else None) for i in range(60)]
    rels = [("a", "B", "USES"), ("A ", "b", "USES"), ("c", "x", "IS"), ("d", "d", "IS"), ("x", "y", "IS")]
    keys = {(k.lower(), i) for i, n, more in e for k in [n, *(more or [])]}
    want = {(i, j, r) for f, t, r in rels for k, i in keys for m, j in keys if k == f.lower().strip() and m == t.lower() and i != j}
    found = resolve.relation_edges(spark.createDataFrame(rels, "from string, to string, rel string"), spark.createDataFrame(e, "id bigint, name string, aliases array<string>"))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")


def test_influence_of_saved_decisions_does_not_group_the_pairs(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(30)), [rng.randrange(12) for _ in range(rng.randrange(5))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, created_at timestamp_ntz, entities array<bigint>")
    found = fanout.SavedDecisions(spark, f"file://{tmp_path}")._influenced(df.where("id >= 20"), df.where("id < 20"))
    of = {i: (t, set(e)) for i, t, e in rows}
    want = {(i, j, len(of[i][1] & of[j][1])) for i in of for j in of if of[i][0] > of[j][0] and max(i, j) >= 20 and len(of[i][1] & of[j][1]) >= 2}
    assert sorted(map(tuple, found.collect())) == sorted(want) and want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" not in plan


def test_cross_user_pairs_are_not_ranked_after_the_join(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["p", "q", None]), rng.randrange(20)) for i in range(120)]
    d = spark.createDataFrame([(i, u, p, dt.datetime(2024, 1, 1) + dt.timedelta(days=t)) for i, u, p, t in rows], "id bigint, user_id bigint, project_name string, created_at timestamp_ntz")
    found = graph.cross_user_pairs(d, d, 3)
    newest = sorted((r for r in rows if r[1] and r[2]), key=lambda r: (-r[3], -r[0]))
    want = [(i, o[0], k) for i, u, p, _ in rows if u and p for k, o in enumerate([x for x in newest if x[2] == p and x[1] != u][:3], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number") == 2


def test_tasks_of_a_text_search_are_as_many_as_its_addends_ask_for(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"ship the order {'ship ' * (i % 4)}by {'air' if i % 3 else 'sea'}") for i in range(60)], "id bigint, text string")
    asked = spark.createDataFrame([(1, "ship by sea"), (2, "the air"), (3, "nothing")], "id bigint, text string")
    whole = sorted((r.query, r.id, round(r.score, 9)) for r in S.bm25(asked, docs, 7).collect())
    monkeypatch.setattr(text_index, "PART_ROWS", 20)
    found = S.bm25(asked, docs, 7)
    assert sorted((r.query, r.id, round(r.score, 9)) for r in found.collect()) == whole
    # ship, by and the are in 60 texts, sea in 20, air in 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 12), REPARTITION_BY_NUM" in plan


def test_counts_of_terms_by_places(spark):
    docs = spark.createDataFrame([(1, "b a b", "B c"), (2, "", None), (3, None, "x")], "id bigint, a string, b string")
    got = sorted(tuple(r) for r in text_index.postings(docs, ["a", "b"]).terms.select("term", "id", "tf", "length").collect())
    assert got == [("a", 1, 1, 5), ("b", 1, 3, 5), ("c", 1, 1, 5), ("x", 3, 1, 1)]


def test_a_context_pack_joins_lengths_instead_of_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rules, "within_budget", lambda df, by, order, chars, budget: (seen.append(df), df.withColumn("spent", chars))[1])
    hits = spark.createDataFrame([(1, 7, 0.5)], "query bigint, id bigint, score double")
    d = spark.createDataFrame([(7, "Pick", None, "one", None)], "id bigint, trigger string, context string, agent_decision string, agent_rationale string")
    pack = S.context_pack(hits, hits, d, spark.createDataFrame([], "src bigint, dst bigint"))
    assert not [c for c, t in seen[0].dtypes if t == "string"] and [r.spent for r in pack.collect()] == [8]


def test_tasks_of_a_graph_are_as_many_as_its_edges_ask_for(spark, monkeypatch):
    from thoughtloom.functions import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 1)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id bigint")
    rows = [(1, 10, "INVOLVES"), (1, 11, "INVOLVES"), (2, 12, "INVOLVES"), (9, 13, "INVOLVES"), (1, 99, "INVOLVES"), (10, 11, "RELATED_TO"), (10, 13, "RELATED_TO"), (2, 1, "SUPERSEDES"), (9, 1, "SUPERSEDES")]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, rel string")
    graph_ = graph.full_graph(ids(1, 2), ids(10, 11, 12, 13), edges)
    assert sorted(map(tuple, graph_.collect())) == [(1, 10, "INVOLVES"), (1, 11, "INVOLVES"), (2, 1, "SUPERSEDES"), (2, 12, "INVOLVES"), (10, 11, "RELATED_TO")]
    decisions = ids(1, 2, 9).withColumn("project_name", F.when(F.col("id") == 9, "p").otherwise("q"))
    d, e, left = integrity.delete_project(decisions, ids(10, 11, 12, 13), edges, "p")
    assert sorted(r.id for r in d.collect()) == [1, 2] and sorted(r.id for r in e.collect()) == [10, 11, 12]
    assert sorted(map(tuple, left.collect())) == sorted(r for r in rows if 9 not in r and 13 not in r)
    for found in (graph_, left):
        assert ", 2), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def _dealt(df):
    """Numbers of tasks that a plan deals rows to."""
    return {int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())}


def test_coverage_chains_contexts_and_violations_deal_rows_by_number(spark, monkeypatch):
    monkeypatch.setattr("thoughtloom.functions.tables.TASK_ROWS", 2)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    made = spark.createDataFrame([(i, 1, day(i), "x", "c", "a", ["we stay on postgres"]) for i in range(20)] + [(3, 1, day(90), "x", "c", "a", [])], "id bigint, user_id bigint, created_at timestamp_ntz, trigger string, context string, agent_decision string, assumptions array<string>")
    pairs = spark.createDataFrame([(i, i % 2) for i in range(20)] * 2 + [(99, 0)], "src bigint, dst bigint")
    files = spark.createDataFrame([(0,), (1,), (2,)], "file bigint")
    cover = metrics.coverage(files, made, pairs, F.lit(day(100)))
    assert sorted((r.file, r.decisions, r.days_since) for r in cover.collect()) == [(0, 10, 82), (1, 10, 10), (2, 0, None)]
    after = spark.createDataFrame([(i + 1, i) for i in range(20)], "src bigint, dst bigint")
    chains = graph.supersession_chains(after, made.where("id > 17"))
    assert sorted((r.start, r.end, r.hops) for r in chains.collect()) == sorted((s, s - h, h) for s in (18, 19) for h in (1, 2, 3))
    names = spark.createDataFrame([(0, "Kafka"), (1, "redis"), (2, " kafka "), (3, None)], "id bigint, name string")
    own = pairs.where("src < 20").union(spark.createDataFrame([(0, 2), (0, 1), (5, 3)], "src bigint, dst bigint"))
    context = graph.entity_context(names.where("id < 2").select("name"), names, own, made.where("created_at < '2024-03-01'"), after.where("dst < 3"))
    assert sorted((r.name, r.decisions, r.current, r.related) for r in context.collect()) == [("Kafka", 10, 8, ["redis"]), ("redis", 11, 9, [" kafka ", "Kafka"])]
    broken = rules.assumption_violations(made.withColumn("trigger", F.when(F.col("id") == 9, "the postgres layer is deprecated").otherwise("x")), 5)
    assert sorted((r.id, r.later_id) for r in broken.collect()) == [(i, 9) for i in range(4, 9)]
    assert max(_dealt(cover)) == 11 and max(_dealt(chains)) == 30 and max(_dealt(context)) == 22 and max(_dealt(broken)) == 22


def test_a_save_leaves_no_settled_tables_and_makes_the_same_in_parts(spark, tmp_path, monkeypatch):
    rows = saved_rows()
    df = spark.createDataFrame(rows, fanout.DECISION)
    shared = Path(tables.shared_folder(spark).removeprefix("file:"))
    state = lambda store: {name: sorted(map(str, (x.withColumn("score", F.round("score", 9)) if name == "similar" else x).collect())) for name, x in ((name, store.read(name)) for name in fanout.TABLES if name != "pools")}
    settled = lambda: {p.name for p in shared.glob("settled-*")}
    before, codec = settled(), spark.conf.get("spark.sql.parquet.compression.codec")
    whole = fanout.SavedDecisions(spark, f"file://{tmp_path}/whole")
    whole.save(df, 0)
    assert settled() == before and spark.conf.get("spark.sql.parquet.compression.codec") == codec
    monkeypatch.setattr(tables, "PART_BYTES", 3000)
    monkeypatch.setattr(fanout, "REVIEW_ROWS", 7)
    monkeypatch.setattr(fanout, "BUCKET_ROWS", 20)
    parts = fanout.SavedDecisions(spark, f"file://{tmp_path}/parts")
    parts.save(df.where("id < 150"), 0)
    parts.save(df.where("id >= 150"), 1)
    assert state(parts) == state(whole)
    assert sorted((r.id, r.other, r.rank) for r in parts.read("reviews").collect()) == brute_reviews(rows)


@pytest.mark.parametrize("most", [1, 2048])
def test_similar_saved_decisions_of_equal_scores_go_by_id(spark, tmp_path, monkeypatch, most):
    # copies of a few vectors: scores that are equal but for rounding must not decide
    rng = random.Random(12)
    kinds = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(3)]
    rows = [(i, i % 2, None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(50)), None, None, None, None, None, None if i % 13 == 0 else kinds[i % 3]) for i in range(130)]
    monkeypatch.setattr(fanout, "GROUP_ROWS", most)
    store = fanout.SavedDecisions(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame(rows, fanout.DECISION)
    store.save(df.where("id < 40"), 0)
    store.save(df.where("id >= 40"), 1)
    batch = lambda r: r[0] >= 40
    want = []
    for r in rows:
        near = sorted(o[0] for o in rows if r[9] and o[9] and o[1] == r[1] and o[0] % 3 == r[0] % 3 and (batch(o), o[3], o[0]) < (batch(r), r[3], r[0]))
        want += [(r[0], o, "high") for o in near[:5]]
    assert sorted((r.src, r.dst, r.tier) for r in store.read("similar").collect()) == sorted(want)


def test_relations_by_name_choose_entities_before_they_meet(spark):
    # a and b have two keys, so their pairs come by both and are made distinct; the others' pairs are not
    e = [(1, "a", ["b"]), (2, "b", ["a"]), (3, "a", None), (4, "b", None), (5, "c", None), (6, None, None)]
    rels = [("a", "b", "USES"), ("b", "a", "USES"), ("a", "c", "USES"), ("c", "B ", "USES"), ("A", "b", "USES")]
    keys = {(k, i) for i, n, more in e for k in [n, *(more or [])] if k}
    want = {(i, j, r) for f, t, r in rels for k, i in keys for m, j in keys if k == f.lower().strip() and m == t.lower().strip() and i != j}
    found = resolve.relation_edges(spark.createDataFrame(rels, "from string, to string, rel string"), spark.createDataFrame(e, "id bigint, name string, aliases array<string>"))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert " OR " not in found._jdf.queryExecution().optimizedPlan().toString()

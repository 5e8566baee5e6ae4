"""Repeated byte strings through a logarithmic family of sparse suffix arrays.

A suffix enters an array where its leading `gram` bytes have the least hash of some `length` - `gram` + 1
neighbouring starts. Two equal strings of `length` bytes therefore hold such an anchor at the same
place, so the arrays see every repeated string of that length while they keep about one suffix in
(length - gram) / 2 bytes. An array is a table of (k, c, n, doc, pos): k is the hash of the leading
`gram` bytes, c that of the anchor's whole neighbourhood (every string of `length` bytes through the
anchor lies in it), n the number of suffixes that share both, and (doc, pos) the least of them. Rows are
ordered by (k, c), the order of suffixes by fingerprint instead of by letter, for only agreement over fixed
lengths matters here.

Beside its array a level keeps its keys (k, n), one row each, in buckets of k that are sorted: a table in the
shared folder. A new batch gets its array and keys, the keys are merge-scanned against those of every
existing level (a sort-merge join of buckets, which neither shuffles nor sorts the level again), and the batch
becomes a level itself; before the next insert levels of equal size merge, so every row is rewritten
log(batches) times. The scans leave the keys k that occur twice. Suffixes with equal neighbourhoods repeat in
full; where neighbourhoods differ, the bytes around the anchors are compared, window by window.

Every string of `length` bytes at an anchor holds the anchor's gram, so what an anchor removes is one
interval, and two numbers (the least and the greatest repeated offset) describe it.

Scale: counts of hot strings combine before the shuffle; joins of arrays on k read stored tables on both sides,
so that a hot k can be split among tasks; groups of up to `small` differing neighbourhoods are compared inside a
task. Of a larger group two strings are counted first for each range of offsets: its cover, the bytes that its
windows have together, and its core, the bytes that each of them has. A repeated cover decides for all windows
of the range, a core that is not repeated against them; only for ranges between are window hashes counted,
across tasks, once for all neighbourhoods with one cover. Texts move twice, packed.

Defined cases: a null text is empty; a very long text is whole in one task, in a few arrays of its length; texts under `length` bytes keep all bytes; rows that repeat an id or
have none are told apart by a row number and give a row each; equal rows repeat each other in full.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, forget, keyed, map_batches, mix, remove, scratch, stored

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + _rng.integers(0, 2, 256, dtype=np.int64).astype(U64)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Powers:
    """_BASE ** -j and _BASE ** j, grown on demand."""

    def __init__(self):
        self.down = self.up = np.ones(1, U64)

    def to(self, n: int):
        if len(self.down) < n:
            size = max(n, 2 * len(self.down), 1 << 16)
            with np.errstate(over="ignore"):
                self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _INVERSE, U64)]), dtype=U64)
                self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE, U64)]), dtype=U64)
        return self.down[:n], self.up[:n]


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each w neighbouring values: doubling, then one overlap."""
    n, size = len(x) - w + 1, 1
    while 2 * size <= w:
        x = f(x[: len(x) - size], x[size:])
        size *= 2
    return f(x[:n], x[w - size : w - size + n])


def anchors_of(data: bytes, length: int, gram: int, powers: Powers, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and the hashes of the grams there; long texts go part by part, with what an anchor depends on at both sides."""
    if len(data) <= 2 * part:
        return _anchors_of(data, length, gram, powers)
    found, side = [], 2 * length
    for first in range(0, len(data), part):
        begin = max(0, first - side)
        at, h = _anchors_of(data[begin : first + part + side], length, gram, powers)
        own = (at >= first - begin) & (at < first - begin + part)
        found.append((at[own] + begin, h[own]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _anchors_of(data: bytes, length: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, U64)
    down, up = powers.to(n)
    with np.errstate(over="ignore"):
        p = np.empty(n + 1, U64)
        p[0] = 0
        np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * down, dtype=U64, out=p[1:])
        h = mix((p[gram:] - p[:-gram]) * up[: n - gram + 1])
    w = length - gram + 1
    least = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, U64)
    most = _sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(k, c, doc, pos) of a table (doc, text)."""
    w = length - gram

    def run(c, powers):
        from xxhash import xxh3_64_intdigest

        ks, cs, ds, ps = [], [], [], []
        for d, t in zip(c["doc"], c["text"]):
            data = t.encode("utf-8", "surrogatepass") if t else b""
            at, k = anchors_of(data, length, gram, powers)
            if len(at):
                ks.append(k)
                ds.append(np.full(len(at), d, np.int64))
                ps.append(at)
                cs.append(np.fromiter((xxh3_64_intdigest(data[max(0, i - w) : i + length], min(i, w)) for i in at.tolist()), U64, len(at)))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        return {"k": join(ks, np.int64), "c": join(cs, np.int64), "doc": join(ds, np.int64), "pos": join(ps, np.int32)}

    return map_batches(docs.select("doc", "text"), run, "k bigint, c bigint, doc bigint, pos int", Powers)


class SuffixFamily:
    """Levels of suffix arrays; insert() returns the keys that the batch repeats, within itself or from a level."""

    def __init__(self, length: int = 400, gram: int | None = None):
        self.length, self.gram = length, gram or length // 4
        self.levels: list[tuple[int, DataFrame, DataFrame]] = []  # (size in batches, array, keys)
        self.members: list[DataFrame] = []
        self.tables: list[tuple[str, str]] = []  # (name, path) of the keys

    def insert(self, docs: DataFrame) -> DataFrame:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a, x), (_, b, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, self._array(a.unionByName(b)), self._keys(x.unionByName(y))))
            forget(a, b)
        members = stored(anchors(docs, self.length, self.gram), "anchors")
        array = self._array(members.select("k", "c", F.lit(1).cast("bigint").alias("n"), "doc", "pos"))
        keys = self._keys(array)
        hits = keys.where("n > 1").select("k")
        for _, _, level in self.levels:
            hits = hits.unionByName(keys.select("k").hint("merge").join(level.select("k"), "k", "left_semi"))
        self.members.append(members)
        self.levels.append((1, array, keys))
        return stored(hits, "hits")

    def close(self) -> None:
        """Drops the tables of keys, when no more batch comes."""
        spark = self.members[0].sparkSession
        for t, path in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {t}")
            remove(spark, path)

    def _keys(self, rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        path, parts = scratch(spark, "keys"), int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = "keys_" + path.rsplit("-", 1)[1]
        keys = rows.groupBy("k").agg(F.sum("n").alias("n")).repartition(parts, "k")
        keys.write.format("parquet").bucketBy(parts, "k").sortBy("k").option("path", path).saveAsTable(name)
        self.tables.append((name, path))
        return spark.table(name)

    def _array(self, rows: DataFrame) -> DataFrame:
        a = rows.groupBy("k", "c").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "pos")).alias("at"))
        return stored(a.select("k", "c", "n", "at.doc", "at.pos").sortWithinPartitions("k", "c"), "array")

    def classes(self, hits: DataFrame) -> DataFrame:
        """(k, c, n, doc, pos, m) of all levels where k is among the hits; m: different neighbourhoods of k."""
        rows = self.levels[0][1]
        for _, level, _ in self.levels[1:]:
            rows = rows.unionByName(level)
        repeated = stored(hits.distinct(), "repeated-keys")
        found = rows.join(repeated, "k", "left_semi")
        if len(self.levels) > 1:
            found = found.groupBy("k", "c").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "pos")).alias("at")).select("k", "c", "n", "at.doc", "at.pos")
        found = stored(found, "classes")
        forget(repeated, *[level for _, level, _ in self.levels])
        m = stored(found.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "mixed")
        out = stored(found.join(m, "k", "left").select("k", "c", "n", "doc", "pos", F.coalesce("m", F.lit(1)).alias("m")), "candidates")
        forget(found, m)
        return out


def _windows(texts: list[bytes], left: np.ndarray, length: int, gram: int):
    """For neighbourhoods aligned at their anchors: prefix sums whose differences are the windows' hashes, and each one's bytes to the right."""
    w = length - gram
    x = np.zeros((len(texts), w + length), np.uint8)
    right = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        x[i, w - left[i] : w - left[i] + len(t)] = np.frombuffer(t, np.uint8)
        right[i] = len(t) - left[i]
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(w + length, _BASE, U64), dtype=U64)
        p = np.zeros((len(texts), w + length + 1), U64)
        np.cumsum(_TABLE[x] * up, axis=1, dtype=U64, out=p[:, 1:])
    return p, right


def _hashes(p: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> np.ndarray:
    w = length - gram
    with np.errstate(over="ignore"):
        return mix(p[:, w - offsets + length] - p[:, w - offsets] + offsets.astype(U64) * U64(0xD6E8FEB86659FD93))


def repeated_offsets(texts: list[bytes], left: np.ndarray, length: int, gram: int, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) offset o for each neighbourhood at which its window, o bytes left of the anchor, is in another one too; -1 if none."""
    p, right = _windows(texts, left, length, gram)
    lo = np.full(len(texts), -1, np.int64)
    hi = np.full(len(texts), -1, np.int64)
    for first in range(0, length - gram + 1, step):
        offsets = np.arange(first, min(first + step, length - gram + 1))
        v = _hashes(p, offsets, length, gram)
        ok = (left[:, None] >= offsets) & (right[:, None] >= length - offsets)
        s = np.sort(v[ok])
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            continue
        at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = ok & (twice[at] == v)
        any_ = hit.any(1)
        lo = np.where(any_ & (lo < 0), offsets[hit.argmax(1)], lo)
        hi = np.where(any_, offsets[len(offsets) - 1 - hit[:, ::-1].argmax(1)], hi)
    return lo, hi


def packed(docs: DataFrame, *others: str) -> DataFrame:
    """(doc, z, others): texts as zstd-packed UTF-8, for shuffles."""
    kinds = dict(docs.dtypes)

    def run(c):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        return {"doc": c["doc"], "z": [z.compress(t.encode("utf-8", "surrogatepass") if t else b"") for t in c["text"]]} | {n: c[n] for n in others}

    return map_batches(docs.select("doc", "text", *others), run, ", ".join(["doc bigint, z binary"] + [f"`{n}` {kinds[n]}" for n in others]))


def _unpack(z: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(z)


def neighbourhoods(reps: DataFrame, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(k, c, m, left, bytes) for class representatives (k, c, doc, pos, m)."""
    w = length - gram

    def run(c):
        out = {"k": [], "c": [], "m": [], "left": [], "bytes": []}
        for z, wanted in zip(c["z"], c["wanted"]):
            data = _unpack(z)
            for x in wanted:
                i = x["pos"]
                out["k"].append(x["k"])
                out["c"].append(x["c"])
                out["m"].append(x["m"])
                out["left"].append(min(i, w))
                out["bytes"].append(data[max(0, i - w) : i + length])
        return out

    wanted = reps.groupBy("doc").agg(F.collect_list(F.struct("pos", "k", "c", "m")).alias("wanted"))
    return map_batches(packed(docs).join(wanted, "doc").select("z", "wanted"), run, "k bigint, c bigint, m bigint, left int, bytes binary")


def compare(near: DataFrame, length: int, gram: int, chunk: int = 2048) -> DataFrame:
    """(k, c, lo, hi) of neighbourhoods that share a window with another of the same k; whole groups of k in a task, many at a time."""

    def run(batches):
        ks: list[int] = []
        cs: list[int] = []
        left: list[int] = []
        texts: list[bytes] = []

        def done(n):
            lo, hi = repeated_offsets(texts[:n], np.array(left[:n], np.int64), length, gram)
            keep = np.flatnonzero(hi >= 0)
            out = pa.RecordBatch.from_arrays([pa.array(np.array(ks[:n], np.int64)[keep]), pa.array(np.array(cs[:n], np.int64)[keep]), pa.array(lo[keep].astype(np.int32)), pa.array(hi[keep].astype(np.int32))], names=["k", "c", "lo", "hi"])
            del ks[:n], cs[:n], left[:n], texts[:n]
            return out

        for b in batches:
            k, c, le, te = (b.column(i).to_pylist() for i in range(4))
            ks += k
            cs += c
            left += le
            texts += te
            while len(ks) >= chunk:
                # cut before the first new key at or after the chunk's end
                end = next((i for i in range(chunk, len(ks)) if ks[i] != ks[i - 1]), None)
                if end is None:
                    break
                yield done(end)
        if ks:
            yield done(len(ks))

    return near.select("k", "c", "left", "bytes").repartition("k").sortWithinPartitions("k").mapInArrow(run, "k bigint, c bigint, lo int, hi int")


def ranges(near: DataFrame, length: int, gram: int, steps: int) -> DataFrame:
    """(k, c, step, core, cover): hashes for each range of offsets; no row where the neighbourhood lacks the core, null where it lacks the cover."""
    edges = _edges(length, gram, steps)
    borders = list(zip(edges.tolist(), (edges[1:] - 1).tolist()))

    def run(c):
        from xxhash import xxh3_64_intdigest

        rows = []
        for k, own, left, text in zip(c["k"], c["c"], c["left"], c["bytes"]):
            right = len(text) - left
            for step, (lo, hi) in enumerate(borders):
                if left >= lo and right >= length - hi:
                    core = xxh3_64_intdigest(text[left - lo : left - hi + length], step) - 2**63
                    whole = left >= hi and right >= length - lo
                    rows.append((k, own, step, core, xxh3_64_intdigest(text[left - hi : left - lo + length], step) - 2**63 if whole else None))
        return dict(zip(("k", "c", "step", "core", "cover"), map(list, zip(*rows)))) if rows else {n: [] for n in ("k", "c", "step", "core", "cover")}

    return map_batches(near.select("k", "c", "left", "bytes"), run, "k bigint, c bigint, step int, core bigint, cover bigint")


def _edges(length: int, gram: int, steps: int) -> np.ndarray:
    """Borders of `steps` ranges of the offsets 0 to length - gram."""
    return np.unique(np.linspace(0, length - gram + 1, steps + 1).astype(np.int64))


def compare_large(near: DataFrame, length: int, gram: int, made: list[DataFrame], steps: int = 8) -> DataFrame:
    """The same for groups too large for a task: hashes of cores and covers, then of windows, are counted across tasks. made: takes the tables stored on the way that the result reads."""
    edges = _edges(length, gram, steps)
    strings = stored(ranges(near, length, gram, steps), "ranges")
    covers = strings.where("cover IS NOT NULL").groupBy("cover").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cover")
    covers = stored(covers, "repeated-covers")
    sure = strings.select("k", "c", "step", "cover").join(covers, "cover").groupBy("k", "c").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    sure = stored(sure, "sure-ranges")
    # between the first and the last repeated cover nothing can move the least and the greatest offset
    done = F.coalesce(F.col("step").between(F.col("first"), F.col("last")), F.lit(False)).alias("done")
    whole = stored(strings.join(sure, ["k", "c"], "left").select("core", "cover", "k", "c", "step", done), "open-ranges")
    forget(strings, covers)
    asked = whole.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("done")).alias("open")).where("n > 1 AND open").select("core")
    asked = stored(asked, "asked-cores")
    open_ = stored(whole.join(asked, "core"), "asked-ranges")
    forget(whole, asked)
    # equal covers have equal windows: of those that are done one stands for all
    one = open_.where("done").groupBy("core", F.coalesce("cover", F.xxhash64("k", "c")).alias("cover")).agg(F.min(F.struct("k", "c", "step")).alias("x")).select("x.k", "x.c", "x.step")
    wanted = stored(open_.where("NOT done").select("k", "c", "step").unionByName(one).groupBy("k", "c").agg(F.collect_set("step").alias("steps")), "wanted-ranges")
    border = F.array(*[F.lit(int(e)) for e in edges])
    forget(open_)
    made.append(sure)
    sure = sure.select("k", "c", F.get(border, F.col("first")).alias("lo"), (F.get(border, F.col("last") + 1) - 1).alias("hi"))

    def run(c):
        left = np.array(c["left"], np.int64)
        p, right = _windows(c["bytes"], left, length, gram)
        offsets = np.arange(length - gram + 1)
        v = _hashes(p, offsets, length, gram).astype(np.int64)
        open_ = np.zeros((len(left), len(edges) - 1), bool)
        for i, s in enumerate(c["steps"]):
            open_[i, s] = True
        ok = (left[:, None] >= offsets) & (right[:, None] >= length - offsets) & np.repeat(open_, np.diff(edges), 1)
        i, j = np.nonzero(ok)
        return {"w": v[ok], "k": np.array(c["k"], np.int64)[i], "c": np.array(c["c"], np.int64)[i], "o": offsets[j].astype(np.int32)}

    rows = near.join(wanted, ["k", "c"]).select("k", "c", "left", "bytes", "steps")
    rows = stored(map_batches(rows, run, "w bigint, k bigint, c bigint, o int"), "windows")
    forget(wanted)
    twice = stored(rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w"), "twice")
    made += [rows, twice]
    return sure.unionByName(rows.join(twice, "w").groupBy("k", "c").agg(F.min("o").alias("lo"), F.max("o").alias("hi")))


def spans(marks: list, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs; marks: (pos, lo, hi) of anchors with repeated offsets lo to hi."""
    found = sorted((max(0, m["pos"] - m["hi"]), min(m["pos"] - m["lo"], n - length) + length) for m in marks)
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def marked(docs: DataFrame, length: int, gram: int | None = None, batches: int = 4, small: int = 1000) -> DataFrame:
    """(doc, marks array<(pos, lo, hi)>) of a table (doc, text), for documents with repeated strings."""
    family = SuffixFamily(length, gram)
    length, gram = family.length, family.gram
    found = [family.insert(docs.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b)) for b in range(batches)]
    family.close()
    classes = family.classes(functools.reduce(DataFrame.unionByName, found))
    forget(*found)
    mixed = classes.where("m > 1")
    near = stored(neighbourhoods(mixed, docs, length, gram), "neighbourhoods")
    part, done = compare(near.where(F.col("m") <= small), length, gram), [near, classes]
    if near.where(F.col("m") > small).limit(1).count():
        part = part.unionByName(compare_large(near.where(F.col("m") > small), length, gram, done))
    full = classes.where("n > 1").select("k", "c", F.lit(0).alias("lo"), F.lit(length - gram).alias("hi"))
    covered = stored(full.unionByName(part).groupBy("k", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "covered")
    forget(*done)
    members = family.members[0]
    for m in family.members[1:]:
        members = members.unionByName(m)
    return members.join(covered, ["k", "c"]).groupBy("doc").agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("marks"))


def op2(docs: DataFrame, length: int = 400) -> DataFrame:
    """Byte counts, removed bytes and runs, and the digest of what is left."""
    rows = keyed(docs.select("doc_id", "text"))

    def run(c):
        out = {"doc_id": c["doc_id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for z, m in zip(c["z"], c["marks"]):
            data = _unpack(z)
            cut = spans(m or [], len(data), length)
            out["n_bytes"].append(len(data))
            out["n_removed"].append(sum(b - a for a, b in cut))
            out["n_spans"].append(len(cut))
            out["kept_sha256"].append(hashlib.sha256(without(data, cut)).hexdigest())
        return out

    marks = stored(marked(rows.select("doc", "text"), length), "marks")
    return map_batches(packed(rows, "doc_id").join(marks, "doc", "left").select("doc_id", "z", "marks"), run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    if not cut:
        return data
    parts, at = [], 0
    for a, b in cut:
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return b"".join(parts)


def stage(spark, docs: DataFrame, sf_dir: str, length: int = 256) -> DataFrame:
    """Documents without the strings of `length` bytes that occur twice; those left without a word go, and characters cut in half go with the string."""
    rows = keyed(docs)
    others = [n for n in docs.columns if n not in ("text", "n_chars")]

    def run(c):
        texts = []
        for z, m in zip(c["z"], c["marks"]):
            data = _unpack(z)
            texts.append(without(data, spans(m or [], len(data), length)).decode("utf-8", "ignore"))
        return {n: c[n] for n in others} | {"text": texts, "n_chars": list(map(len, texts))}

    marks = stored(marked(rows.select("doc", "text"), length), "marks")
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in others] + ["text string", "n_chars bigint"])
    out = map_batches(packed(rows, *others).join(marks, "doc", "left").select(*others, "z", "marks"), run, schema)
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)

"""Near-duplicate groups by one-permutation MinHash.

1. Shingles: n-word windows of the lower-cased (A-Z) text, as 64-bit hashes; a text with fewer words is
   one shingle of all its words. Documents with the same shingle set are one class; the class is
   represented by its least id, and only representatives go on.
2. Signature: one permutation, `bins` bins; empty bins are filled by optimal densification (each empty bin
   draws bins by a universal hash of (bin, attempt) until it meets a full one).
3. Bands: `rows` bins a band make a bucket key. In a bucket every member gets one edge to the least
   member (a star), so a bucket of m members has m - 1 edges. Edges whose signatures agree in `doubt` of
   the bins are candidates; `doubt` lies five standard errors below the threshold.
4. A star can miss pairs that are both far from its centre: buckets whose members lie in several
   components of the candidates are compared once more, in square blocks of signatures, and give the
   edges of a spanning forest. The components of all candidates are the neighbourhoods: linked
   documents lie in one neighbourhood, except with probability (1 - s^rows)^bands, below 1e-8 at s = 0.85.
5. Inside each neighbourhood the full shingle sets decide. One of up to `block` members meets in one
   task. A larger one first links its members to its pivot, the member nearest to the mode of all
   signatures; the rest then meets all others in pairs of blocks. Tasks return spanning links only.

Nothing is capped, and no step returns more rows than a neighbourhood or bucket has members.

Defined cases: null or empty texts (and texts without words) have the empty set, are linked with
nothing and are their own component; near_duplicates() takes unique ids, op9() and the stage give rows that
repeat an id, or have none, keys of their own; the shingles of a very long text are whole in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, components, keyed, map_batches, mix, stored

#: A-Z to a-z on UTF-8 bytes.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Signer:
    def __init__(self, n: int, bins: int, rows: int):
        self.n, self.bins, self.rows = n, bins, rows
        self.hash = WordHashes()
        with np.errstate(over="ignore"):
            self.factors = mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
            # draws[t, i]: the bin that empty bin i tries at attempt t
            t, i = np.meshgrid(np.arange(64 * bins, dtype=U64)[: 16 * bins], np.arange(bins, dtype=U64), indexing="ij")
            self.draws = (mix(t * U64(0x1000003) + i * U64(0x9E3779B1) + U64(77)) % U64(bins)).astype(np.int64)
            self.bands = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingle hashes, ascending."""
        if not text:
            return np.empty(0, U64)
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.empty(0, U64)
        h, n = self.hash.of(words), self.n
        with np.errstate(over="ignore"):
            if len(h) < n:
                x = U64(len(h))
                for w in h:
                    x = mix(np.array([x * U64(31) + w], U64))[0]
                return np.array([x], U64)
            x = h[: len(h) - n + 1] * self.factors[0]
            for i in range(1, n):
                x = x + mix(h[i : len(h) - n + 1 + i] * self.factors[i])
            return np.unique(mix(x))

    def signature(self, s: np.ndarray) -> np.ndarray:
        """uint16 for each bin: the end of the least hash in it; s must not be empty."""
        with np.errstate(over="ignore"):
            h = np.sort(mix(s + U64(0x5851F42D4C957F2D)))
        b = ((h >> U64(32)) * U64(self.bins) >> U64(32)).astype(np.int64)  # ascending, as h is
        first = np.concatenate([[True], b[1:] != b[:-1]])
        sig = np.zeros(self.bins, np.uint16)
        full = np.zeros(self.bins, bool)
        full[b[first]] = True
        sig[b[first]] = (h[first] & U64(0xFFFF)).astype(np.uint16)
        own = full.copy()
        empty = np.flatnonzero(~full)
        for t in range(0, len(self.draws), 16):
            if not len(empty):
                break
            tried = self.draws[t : t + 16, empty]
            found = own[tried]
            some = found.any(0)
            sig[empty[some]] = sig[tried[found.argmax(0)[some], np.flatnonzero(some)]]
            empty = empty[~some]
        return sig

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        with np.errstate(over="ignore"):
            x = sig.astype(U64).reshape(-1, self.rows)
            return mix((mix(x + self.bands) * self.bands).sum(1, dtype=U64) + np.arange(len(x), dtype=U64)).astype(np.int64)


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a shingle set."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=U64).astype(np.int64)), int((mix(s ^ U64(0xA5A5A5A5A5A5A5A5)) * U64(0xD6E8FEB86659FD93)).sum(dtype=U64).astype(np.int64))


def signatures(docs: DataFrame, n: int = 3, bins: int = 120, rows: int = 5) -> DataFrame:
    """(id, n_shingles, c1, c2, sig binary): one row for each row of docs (doc_id, text); sig is null for the empty set."""

    def setup():
        return Signer(n, bins, rows)

    def run(c, z):
        out = {"id": c["doc_id"], "n_shingles": [], "c1": [], "c2": [], "sig": []}
        for t in c["text"]:
            s = z.shingles(t)
            a, b = class_of(s) if len(s) else (0, 0)
            out["n_shingles"].append(len(s))
            out["c1"].append(a)
            out["c2"].append(b)
            out["sig"].append(z.signature(s).tobytes() if len(s) else None)
        return out

    return map_batches(docs.select("doc_id", "text"), run, "id bigint, n_shingles bigint, c1 bigint, c2 bigint, sig binary", setup)


def buckets(reps: DataFrame, n: int, bins: int, rows: int) -> DataFrame:
    """(key, id) for each band of each representative."""

    def setup():
        return Signer(n, bins, rows)

    def run(c, z):
        ids, keys = [], []
        for i, s in zip(c["id"], c["sig"]):
            k = z.keys(np.frombuffer(s, np.uint16))
            keys.append(k)
            ids.append(np.full(len(k), i, np.int64))
        return {"key": np.concatenate(keys) if keys else [], "id": np.concatenate(ids) if ids else []}

    return map_batches(reps.select("id", "sig"), run, "key bigint, id bigint", setup)


def _agree(edges: DataFrame, reps: DataFrame, bins: int, doubt: float) -> DataFrame:
    """The edges (a, b) whose signatures agree in `doubt` of the bins."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, bins) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= doubt * bins))

    sig = reps.select("id", "sig")
    both = edges.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


class Forest:
    """Union-find over positions, for the spanning edges of one task."""

    def __init__(self, groups: np.ndarray):
        """groups: a label for each position; equal labels start in one tree."""
        self.of = np.unique(groups, return_inverse=True)[1]

    def differ(self, i: int) -> np.ndarray:
        return self.of != self.of[i]

    def join(self, i: int, js: np.ndarray) -> list[int]:
        """Links i to each of js; those that were in another tree, one of each."""
        roots, first = np.unique(self.of[js], return_index=True)
        new = roots != self.of[i]
        self.of[np.isin(self.of, roots[new])] = self.of[i]
        return js[first[new]].tolist()


def _across(rows: DataFrame, reps: DataFrame, bins: int, doubt: float, block: int) -> DataFrame:
    """Edges (a, b) that join different components of one bucket whose signatures agree in `doubt` of the bins.

    rows: (key, id, component, m), m members in the bucket. A bucket falls into ceil(m / block) parts; each
    pair of parts is one group, so a member is sent once for each part and no group has more than two parts.
    """
    parts = F.ceil(F.col("m") / F.lit(float(block))).cast("int")
    dealt = (
        rows.withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "id", "component", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
        .join(reps.select("id", "sig"), "id")
    )

    def compare(table):
        import pyarrow as pa

        ids = table["id"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, bins)
        forest = Forest(table["component"].to_numpy())
        a, b = [], []
        for i in range(len(ids)):
            other = np.flatnonzero(forest.differ(i))
            if not len(other):
                break
            near = other[(sig[other] == sig[i]).sum(1) >= doubt * bins]
            for j in forest.join(i, near) if len(near) else []:
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "p", "q").applyInArrow(compare, "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, s): the full shingle sets, packed, of the wanted documents."""

    def run(c, z):
        return {"id": c["doc_id"], "s": [z.shingles(t).tobytes() for t in c["text"]]}

    wanted = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    return map_batches(wanted, run, "id bigint, s binary", lambda: Signer(n, 1, 1))


def _similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(u, v, assume_unique=True).size
    return 100 * both >= percent * (len(u) + len(v) - both)


def _pivots(near: DataFrame, reps: DataFrame, bins: int) -> DataFrame:
    """(hood, pivot): of each neighbourhood the member that agrees best with the most frequent value of each bin."""

    def values(c):
        v = np.frombuffer(b"".join(c["sig"]), np.uint16).reshape(-1, bins)
        return {"hood": np.repeat(np.array(c["hood"], np.int64), bins), "id": np.repeat(np.array(c["id"], np.int64), bins), "bin": np.tile(np.arange(bins, dtype=np.int32), len(v)), "v": v.ravel().astype(np.int32)}

    rows = stored(map_batches(near.join(reps.select("id", "sig"), "id").select("hood", "id", "sig"), values, "hood bigint, id bigint, bin int, v int"), "bins")
    mode = rows.groupBy("hood", "bin", "v").count().groupBy("hood", "bin").agg(F.max(F.struct("count", "v"))["v"].alias("v"))
    mode = stored(mode, "modes")
    fit = rows.join(mode, ["hood", "bin", "v"]).groupBy("hood", "id").count()
    return fit.groupBy("hood").agg(F.max(F.struct("count", -F.col("id")))).toDF("hood", "x").select("hood", (-F.col("x").getField("col2")).alias("pivot"))


def _to_pivots(near: DataFrame, pivots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between pivots and the members of their neighbourhoods."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([_similar(np.frombuffer(p, U64), np.frombuffer(q, U64), percent) for p, q in zip(x, y)], pa.bool_()))

    center = stored(pivots.join(sets, pivots.pivot == sets.id).select("hood", F.col("pivot").alias("a"), F.col("s").alias("x")), "pivots")
    members = stored(near.join(sets, "id").select("hood", F.col("id").alias("b"), F.col("s").alias("y")), "members")
    return members.join(center, "hood").where("a <> b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _inside(near: DataFrame, sets: DataFrame, percent: int, block: int, shingles: int = 1 << 21) -> DataFrame:
    """Spanning links (a, b) of the neighbourhoods (hood, id, component, main): pairs of which one side at least is not in the main component.

    A block has about `block` members and `shingles` shingles at most; a text longer than that is a block's whole bulk.
    """
    sized = near.join(sets.select("id", (F.length("s") / 8).alias("size")), "id")
    parts = [F.ceil(F.greatest(F.count_if(c) / F.lit(float(block)), F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)) / F.lit(float(shingles)))).cast("int") for c in (~F.col("main"), F.col("main"))]
    count = sized.groupBy("hood").agg(parts[0].alias("nr"), parts[1].alias("nm")).where("nr > 0")
    near = near.join(stored(count, "hoods"), "hood")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("nm")).otherwise(F.col("nr"))).cast("int")
    # a pair of blocks is (i, j): i a block of the rest, j < nr another block of it or j - nr a block of the main component
    rest_pairs = F.transform(F.sequence(F.lit(0), F.col("nr") + F.col("nm") - 1), lambda j: F.when(j < F.col("mine"), F.struct(j.alias("i"), F.col("mine").alias("j"))).otherwise(F.struct(F.col("mine").alias("i"), j.alias("j"))))
    main_pairs = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda i: F.struct(i.alias("i"), (F.col("nr") + F.col("mine")).alias("j")))
    dealt = near.withColumn("mine", mine).withColumn("pair", F.explode(F.when(F.col("main"), main_pairs).otherwise(rest_pairs)))
    rows = dealt.select("hood", "pair.i", "pair.j", "id", "component", "main").join(sets, "id")

    def compare(table):
        import pyarrow as pa

        ids, packed = table["id"].to_numpy(), table["s"].to_pylist()
        lengths = np.array([len(p) // 8 for p in packed])
        of = np.unique(np.frombuffer(b"".join(packed), U64), return_inverse=True)[1].astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        forest = Forest(table["component"].to_numpy())
        flag = np.zeros(int(of.max()) + 1, np.int32)
        a, b = [], []
        for i in np.flatnonzero(~table["main"].to_numpy(zero_copy_only=False)):
            if not forest.differ(i).any():
                continue
            own = of[starts[i] : starts[i] + lengths[i]]
            flag[own] = 1
            both = np.add.reduceat(flag[of], starts)
            flag[own] = 0
            near_ = np.flatnonzero((100 * both >= percent * (lengths + lengths[i] - both)) & forest.differ(i))
            for j in forest.join(i, near_) if len(near_) else []:
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("hood", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 85, bins: int = 160, rows: int = 5, doubt: float | None = None, block: int = 1000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each distinct doc_id."""
    s = percent / 100
    doubt = max(0.0, s - 5 * (s * (1 - s) / bins) ** 0.5) if doubt is None else doubt
    base = stored(signatures(docs, n, bins, rows), "signatures")
    full = base.where("n_shingles > 0 AND id IS NOT NULL")
    classes = stored(full.groupBy("c1", "c2").agg(F.min("id").alias("rep")), "classes")
    reps = stored(full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "sig"), "representatives")

    keyed = stored(buckets(reps, n, bins, rows), "buckets")
    heads = stored(keyed.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1"), "heads")
    members = stored(keyed.join(heads, "key"), "members")
    edges = stored(members.where("a <> id").select("a", F.col("id").alias("b")).distinct(), "edges")
    candidates = stored(_agree(edges, reps, bins, doubt), "candidates")
    held = members.select("id").distinct()
    hoods = stored(components(held, candidates), "neighbourhoods")

    spread = stored(members.join(hoods, "id"), "spread")
    mixed = stored(spread.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "mixed")
    more = stored(_across(spread.join(mixed, "key").select("key", "id", "component", "m"), reps, bins, doubt, block), "across")
    if more.limit(1).count():
        hoods = stored(components(held, candidates.unionByName(more)), "neighbourhoods")
    size = stored(hoods.groupBy(F.col("component").alias("hood")).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "hoods")
    near = stored(hoods.withColumnRenamed("component", "hood").join(size, "hood"), "near")
    sets = stored(_sets(docs, near, n), "sets")
    placed = near.select("hood", "id", F.col("id").alias("component"), F.lit(False).alias("main"))
    links = None
    large = near.where(F.col("m") > block).select("hood", "id")
    if large.limit(1).count():
        pivots = stored(_pivots(large, reps, bins), "pivots")
        links = stored(_to_pivots(large, pivots, sets, percent), "pivot-links")
        linked = links.select(F.col("b").alias("id"), F.col("a").alias("p"))
        placed = placed.join(linked, "id", "left").join(pivots.select(F.col("pivot").alias("id"), F.col("pivot").alias("q")), "id", "left")
        own = F.coalesce("p", "q")
        placed = stored(placed.select("hood", "id", F.coalesce(own, F.col("component")).alias("component"), own.isNotNull().alias("main")), "placed")
    found = stored(_inside(placed, sets, percent, block), "links")
    comp = stored(components(near.select("id"), found if links is None else found.unionByName(links)), "components")
    whole = full.join(classes, ["c1", "c2"]).join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return whole.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "rep").alias("component_id")).unionByName(
        base.where("n_shingles = 0 OR id IS NULL").select(F.col("id").alias("doc_id"), "n_shingles", F.col("id").alias("component_id"))
    )


def op9(docs: DataFrame) -> DataFrame:
    """Three-word shingles at 85 per cent, one row for each row; kept marks the least document of each component.

    Where ids repeat or are null, rows are judged by a key of their own: the component is the least id in it (null
    if it has none), and of rows with that id the first alone is kept.
    """
    rows = keyed(docs.select("doc_id", "text"))
    found = near_duplicates(rows.select(F.col("doc").alias("doc_id"), "text"))
    if not rows.where("NOT doc <=> doc_id").limit(1).count():
        return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = stored(found.withColumnsRenamed({"doc_id": "doc", "component_id": "component"}).join(rows.select("doc", "doc_id"), "doc"), "named")
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")).alias("x"))
    return named.join(least, "component").select("doc_id", "n_shingles", F.col("x.doc_id").alias("component_id"), (F.col("doc") == F.col("x.doc")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the least id (null last), of each near-duplicate group (five-word shingles, similarity 0.8).

    Rows are judged, not ids: different texts under one id stay, copies go whatever their ids. Rows without a
    word are copies only if id and text are equal.
    """
    rows = keyed(docs)
    groups = stored(near_duplicates(rows.select(F.col("doc").alias("doc_id"), "text"), n=5, percent=80, bins=160, rows=4), "groups").withColumnRenamed("doc_id", "doc")
    found = rows.select("doc", "doc_id", F.md5("text").alias("text")).join(groups, "doc")
    blank = F.col("n_shingles") == 0
    group = (F.when(~blank, F.col("component_id")).alias("c"), F.when(blank, F.col("doc_id")).alias("i"), F.when(blank, F.col("text")).alias("t"))
    kept = found.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc"))["doc"].alias("doc")).select("doc")
    return rows.join(kept, "doc", "left_semi").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS c FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.c, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

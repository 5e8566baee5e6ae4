"""I-Match fingerprints.

Terms are lower-cased words without ASCII punctuation. The lexicon is the band of terms whose document
frequency lies between two shares of the corpus (an inverse-document-frequency band), counted over all
documents. Each slot of a fingerprint is one randomised subset of the lexicon: a term is in slot j at tier
t with probability 2^-t, decided by a hash; the slot's value hashes the distinct terms of the text that lie in
the subset, 0 if there is none. (The hash is that of a set, a sum of mixed term hashes cut to 16 bits: it equals
a hash of the sorted terms in that equal sets have equal values, and needs no sort for each slot.) A fingerprint
holds the tier that fits its number of lexicon terms and the next, sparser one, so texts up to about four times
apart in length can be compared, and one slot more for the subset that is the whole vocabulary: all distinct
terms of the text. The likeness of two fingerprints is the share of equal values among the slots that are filled
in either; texts without a lexicon term are thus alike only if all their terms agree.

The slot for all terms is no subset of the band, hence no I-Match slot in the strict sense; it counts as one slot of
65. Tiers more than one apart (lexicon terms in a ratio above about four) have the likeness 0.

Bound of what is broadcast: terms of a frequency of `least` of the documents or more are at most (mean number of
distinct terms a document) / `least`, 8 bytes each, however many documents there are. A lexicon of up to `most_terms`
is broadcast; a larger one stays a table, which the terms of the documents meet in a join. Both give the same
fingerprints; the join moves 8 bytes for each distinct term of a text, its edited form and its successor.

Defined cases: a null text is empty; texts without terms have the empty fingerprint, and two of these are alike
(1); null ids come first in the order of documents, rows that repeat an id are ordered by their packed text; a
table of one row is its own next; a very long text is whole in one task, in a few times its size.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, forget, map_batches, mix, stored

SLOTS = 64
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
with np.errstate(over="ignore"):
    _SALTS = mix(np.arange(1, SLOTS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))


def terms(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct term hashes, ascending."""
    if not text:
        return np.empty(0, U64)
    return np.unique(hashes.of(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()))


def lexicon(docs: DataFrame, least: float = 0.0005, most: float = 0.02, most_terms: int = 1 << 24) -> np.ndarray | DataFrame:
    """The hashes of the terms in the band, ascending, or beyond `most_terms` a table of them (h); limits as shares of the documents."""

    def run(c, hashes):
        found = [terms(t, hashes) for t in c["text"]]
        h, n = np.unique(np.concatenate(found) if found else np.empty(0, U64), return_counts=True)
        return {"h": h.astype(np.int64), "n": n.astype(np.int64)}

    counts = map_batches(docs.select("text"), run, "h bigint, n bigint", WordHashes).groupBy("h").agg(F.sum("n").alias("n"))
    counts = stored(counts.where("n > 1"), "frequencies")
    total = docs.count()
    band = counts.where((F.col("n") >= least * total) & (F.col("n") <= most * total)).select("h")
    if band.count() > most_terms:
        return band
    rows = band.toArrow()
    forget(counts)
    return np.sort(rows.column("h").to_numpy().astype(np.int64).astype(U64))


def whole(own: np.ndarray) -> bytes:
    """16 bits for the set of all terms, 0 for none."""
    with np.errstate(over="ignore"):
        return (np.uint16(max(1, int(mix(mix(own).sum(keepdims=True, dtype=U64))[0] & U64(0xFFFF)))) if len(own) else np.uint16(0)).tobytes()


def fingerprint(own: np.ndarray, lex: np.ndarray) -> bytes:
    """One byte of tier, 16 bits for all terms, then 16 bits for each slot of the tier and of the next."""
    return packed(whole(own), own[lex[np.minimum(np.searchsorted(lex, own), len(lex) - 1)] == own] if len(lex) else own[:0])


def packed(all_terms: bytes, own: np.ndarray) -> bytes:
    """The fingerprint of a text from its slot of all terms and its terms in the lexicon, in any order."""
    n = len(own)
    tier = max(0, round(np.log2(n))) if n else 0
    slots = np.zeros((2, SLOTS), np.uint16)
    if n:
        with np.errstate(over="ignore"):
            draw = mix(own[:, None] ^ _SALTS[None, :]) >> U64(24)
            value = mix(own)
            for i in (0, 1):
                inside = draw < U64(1 << 40 >> (tier + i))
                total = np.where(inside, value[:, None], U64(0)).sum(0, dtype=U64)
                v = (mix(total + _SALTS) & U64(0xFFFF)).astype(np.uint16)
                slots[i] = np.where(inside.any(0), np.maximum(v, 1), 0)
    return bytes([tier]) + all_terms + slots.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    tier = max(a[0], b[0])
    if tier - min(a[0], b[0]) > 1:
        return 0.0
    x, y = (np.frombuffer(f[1:3] + f[3 + 2 * SLOTS * (tier - f[0]) :][: 2 * SLOTS], np.uint16) for f in (a, b))
    filled = (x > 0) | (y > 0)
    n = int(filled.sum())
    return float(((x == y) & filled).sum() / n) if n else 0.0


def _held(df: DataFrame, band: DataFrame, names: list[str]) -> DataFrame:
    """df (row, ...) with each array of term hashes cut to those in the band; null where none is left."""
    each = df.select("row", F.posexplode(F.array(*names)).alias("k", "hs")).select("row", "k", F.explode("hs").alias("h"))
    kept = each.join(band, "h").groupBy("row").agg(*(F.collect_list(F.when(F.col("k") == i, F.col("h"))).alias(n) for i, n in enumerate(names)))
    return df.drop(*names).join(kept, "row", "left")


def _hashes(values: list | None) -> np.ndarray:
    return np.array(values or [], np.int64).astype(U64)


def fingerprints(docs: DataFrame, lex: np.ndarray | DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each row, hexadecimal."""
    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(lex, DataFrame):

        def cut(c, hashes):
            own = [terms(t, hashes) for t in c["text"]]
            return {"id": c["id"], "all": [whole(x) for x in own], "own": [x.astype(np.int64) for x in own]}

        wide = stored(map_batches(rows, cut, f"id {kind}, all binary, own array<bigint>", WordHashes).withColumn("row", F.monotonically_increasing_id()), "terms")
        held = _held(wide, lex, ["own"])
        out = map_batches(held.select("id", "all", "own"), lambda c: {"id": c["id"], "fingerprint": [packed(a, _hashes(x)).hex() for a, x in zip(c["all"], c["own"])]}, f"id {kind}, fingerprint string")
        return out.withColumnRenamed("id", id_col)
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(c, hashes):
        return {"id": c["id"], "fingerprint": [fingerprint(terms(t, hashes), shared.value).hex() for t in c["text"]]}

    return map_batches(rows, run, f"id {kind}, fingerprint string", WordHashes).withColumnRenamed("id", id_col)


def _borders(docs: DataFrame) -> tuple[list[int], bool]:
    """Least ids of ranges of about equal numbers of rows, and whether there are null ids: as many as partitions, from the ids alone."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cuts = ids.where("doc_id IS NOT NULL").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("lo")).collect()
    return sorted({r.lo for r in cuts}), bool(ids.where("doc_id IS NULL").limit(1).count())


def with_next(docs: DataFrame, lex: np.ndarray | DataFrame) -> DataFrame:
    """Each document with its successor by ascending id, as op1 needs it.

    Documents go to id ranges with their packed text and fingerprint, once; the first of a range also goes
    to the range before it (the first of all to the last), so every successor is in the same range. Where the
    lexicon is a table, pairs give the terms of both texts and of the edited one, and fingerprints follow its join.
    """
    borders, nulls = _borders(docs)
    last = max(0, len(borders) - 1)
    edges = np.array(borders, np.int64)
    joined = isinstance(lex, DataFrame)
    shared = None if joined else docs.sparkSession.sparkContext.broadcast(lex)

    def prepare(c, hashes):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        out = {"part": [], "guest": [], "doc_id": [], "z": [], "f": []}

        def add(part, guest, d, text, f):
            for k, v in zip(out, (part, guest, d, text, f)):
                out[k].append(v)

        for d, t in zip(c["doc_id"], c["text"]):
            f = b"" if joined else fingerprint(terms(t, hashes), shared.value)
            text = z.compress((t or "").encode("utf-8", "surrogatepass"))
            part = 0 if d is None else int(max(0, np.searchsorted(edges, d, "right") - 1))
            add(part, 0, d, text, f)
            if d is None or (part == 0 and not nulls and d == borders[0]):
                add(last, 1, d, text, f)
            elif part and d == borders[part]:
                add(part - 1, 1, d, text, f)
        return out

    rows = map_batches(docs.select("doc_id", "text"), prepare, "part int, guest int, doc_id bigint, z binary, f binary", WordHashes)
    rows = rows.repartition("part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "z")

    def pair(batches):
        import pyarrow as pa
        import zstandard

        hashes = WordHashes()
        common = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string())]
        if joined:
            kinds = [*common, ("all", pa.binary()), *((n, pa.list_(pa.int64())) for n in ("own", "edited", "following"))]
        else:
            kinds = [*common, ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

        def text(z):
            return zstandard.decompress(z).decode("utf-8", "surrogatepass")

        def done(a, b):
            own, other = text(a[3]), text(b[3])
            half = len(own) // 2
            edited = own[: len(own) - half] + other[:half]
            head = (a[2], len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
            if joined:
                sets = [terms(t, hashes) for t in (own, edited, other)]
                return (*head, b"".join(map(whole, sets)), *(x.astype(np.int64) for x in sets))
            e = fingerprint(terms(edited, hashes), shared.value)
            return (*head, a[4].hex(), e.hex(), likeness(a[4], e), likeness(a[4], b[4]))

        def batch_of(rows):
            columns = list(zip(*rows)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

        before, out, size = None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if before and before[0] == row[0] and not before[1]:
                    out.append(done(before, row))
                    size += sum(map(len, out[-1][4:])) if joined else 0
                before = row
                if size > 1_000_000:
                    yield batch_of(out)
                    out, size = [], 0
            yield batch_of(out)
            out, size = [], 0

    if not joined:
        return rows.mapInArrow(pair, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    wide = rows.mapInArrow(pair, "doc_id bigint, n_chars bigint, edited_sha256 string, all binary, own array<bigint>, edited array<bigint>, following array<bigint>")
    held = _held(stored(wide.withColumn("row", F.monotonically_increasing_id()), "terms"), lex, ["own", "edited", "following"])

    def finish(c):
        out = {n: c[n] for n in ("doc_id", "n_chars", "edited_sha256")} | {n: [] for n in ("fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        for a, *sets in zip(c["all"], c["own"], c["edited"], c["following"]):
            f, e, g = (packed(a[2 * i : 2 * i + 2], _hashes(x)) for i, x in enumerate(sets))
            for n, v in zip(("fingerprint", "edited_fingerprint", "near_edited", "near_next"), (f.hex(), e.hex(), likeness(f, e), likeness(f, g))):
                out[n].append(v)
        return out

    return map_batches(held, finish, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1(docs: DataFrame, most_terms: int = 1 << 24) -> DataFrame:
    return with_next(docs, lexicon(docs, most_terms=most_terms))

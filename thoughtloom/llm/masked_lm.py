"""Masked pseudo-likelihood of documents.

P(word | window) = P(class | window) * P(word | its class), summed as logarithms over all words of a document.

Classes: the most frequent words of the corpus are classes of their own, all others share classes by a hash of
their ending. The window holds `reach` words on both sides. For each distance d Spark counts all windows (class
d places to the left, class d places to the right, class of the word) of the corpus, a network with one hidden
layer is fitted to the counts in numpy, full batch, and tabulated; P(class | window) is the mixture of the
distances' networks with fixed weights, so it is normalised.

Words: the vocabulary is that of the corpus and grows with it. A word whose count is at least the root of the
number of tokens / 256 has its own probability in its class, its share of the class's tokens; the rarer words of
a class share what is left evenly over their number of types. Over all types of the corpus the probabilities of
a window add up to 1. (A first version chose the word by a second network along Huffman trees, fitted to all
windows in shards: 1618 CPU seconds a GB in the check tool, budget 960.)

Bounds: the tables have reach * size ** 3 cells whatever the corpus; the words with a probability of their own
are at most 256 * the root of the number of tokens, 12 bytes each, and are broadcast.

Defined cases: null, empty and blank texts have no tokens, sum 0 and mean 0; beyond a text's ends lies the
boundary; repeated rows are counted and scored each; words that the corpus does not have score as rare ones of
their class; an empty table gives no rows; a very long text is whole in one task, in a few arrays of its length.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, forget, map_batches, slices, stored

EDGE = 0


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def _hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), U64, len(found))


def _endings(found: list[bytes]) -> np.ndarray:
    return _hashes([w[-3:] for w in found])


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, e, n): hash, hash of the ending and count of every word of the corpus."""

    def run(c):
        n = Counter(chain.from_iterable(map(words, c["text"])))
        found = list(n)
        return {"h": _hashes(found).astype(np.int64), "e": _endings(found).astype(np.int64), "n": np.fromiter(n.values(), np.int64, len(n))}

    return map_batches(docs.select("text"), run, "h bigint, e bigint, n bigint").groupBy("h", "e").agg(F.sum("n").alias("n"))


class Lexicon:
    """Ids: 0 is the boundary, then the words with a probability of their own by hash, then the rare words of each class.

    classes: of the ids; log_share: log P(word | class).
    """

    def __init__(self, own: np.ndarray, size: int, h: np.ndarray, e: np.ndarray, n: np.ndarray, rest: np.ndarray, types: np.ndarray):
        """own: hashes of the words that are classes; h, e, n: hashes, endings' hashes and counts of words with a probability; rest, types: tokens and types of rarer words in each class."""
        self.size, self.own, self.first = size, np.sort(own), 1 + len(own)
        order = np.argsort(h)
        self.hash, n = h[order], n[order].astype(np.float64)
        inner = self.class_of(self.hash, e[order])
        self.classes = np.concatenate([[EDGE], inner, np.arange(size)]).astype(np.int32)
        mass = np.bincount(inner, n, size) + rest
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.log(np.concatenate([[1.0], n / mass[inner], np.where(rest > 0, rest, 1) / np.maximum(types, 1) / np.maximum(mass, 1)]))
        self.log_share = share.astype(np.float32)

    def class_of(self, h: np.ndarray, e: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, h), max(0, len(self.own) - 1))
        shared = self.first + (e % U64(self.size - self.first)).astype(np.int64)
        return np.where(self.own[at] == h, 1 + at, shared) if len(self.own) else shared

    def ids(self, found: list[bytes]) -> np.ndarray:
        h = _hashes(found)
        at = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        rare = 1 + len(self.hash) + self.class_of(h, _endings(found))
        return np.where(self.hash[at] == h, 1 + at, rare) if len(self.hash) else rare

    def __len__(self) -> int:
        return len(self.classes)


class Ids:
    """Ids of texts, through a bounded cache (a pure function of the word)."""

    def __init__(self, lexicon: Lexicon, most: int = 400_000):
        self.x, self.most, self.known = lexicon, most, {}

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of words of each text)."""
        found = list(map(words, texts))
        if len(self.known) > self.most:
            self.known = {}
        new = list(set(chain.from_iterable(found)).difference(self.known))
        self.known.update(zip(new, self.x.ids(new).tolist()))
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum())), n


def neighbours(classes: np.ndarray, n: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes d places to the left and right of each word, in texts of n words."""
    ends = np.cumsum(n)
    place = np.arange(len(classes)) - np.repeat(ends - n, n)
    left, right = np.full_like(classes, EDGE), np.full_like(classes, EDGE)
    left[d:] = np.where(place[d:] >= d, classes[:-d], EDGE)
    right[:-d] = np.where(place[:-d] < np.repeat(n, n)[:-d] - d, classes[d:], EDGE)
    return left, right


def lexicon(counts: DataFrame, size: int, own: int) -> Lexicon:
    """From word_counts(): two bounded collects, the vocabulary and the sums of the classes."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "h").limit(own).select("h").toArrow().column(0).to_numpy().astype(U64)
    least = max(2, math.ceil(total**0.5 / 256))
    found = counts.where(F.col("n") >= least).toArrow()
    h, e, n = (found.column(k).to_numpy() for k in ("h", "e", "n"))
    shared = size - 1 - len(top)
    # the ending's hash is unsigned: a modulus of two halves gives that of the whole
    unsigned = (F.shiftrightunsigned("e", 1) % shared * 2 + F.col("e").bitwiseAND(F.lit(1))) % shared
    rare = counts.where(F.col("n") < least).where(~F.col("h").isin([int(x) for x in top.astype(np.int64)]))
    sums = rare.groupBy(unsigned.alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    rest, types = np.zeros(size), np.zeros(size)
    for r in sums:
        rest[1 + len(top) + r.k], types[1 + len(top) + r.k] = r.n, r.types
    keep = ~np.isin(h.astype(U64), top)  # a class of one word needs no share
    return Lexicon(top, size, *(np.concatenate([x[keep].astype(U64), y]) for x, y in ((h, top), (e, top))), np.concatenate([n[keep], np.ones(len(top), np.int64)]), rest, types)


def windows(docs: DataFrame, x: Lexicon, reach: int) -> DataFrame:
    """(d, w, n): counts of all windows of distance d, w = (left * size + right) * size + word; a task sends each window once."""
    shared, size = docs.sparkSession.sparkContext.broadcast(x), x.size
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        ids, counts = Ids(shared.value), np.zeros((reach, size**3), np.int64)
        for b in batches:
            for part in slices(b):
                found, n = ids.of(part.column(0).to_pylist())
                c = shared.value.classes[found].astype(np.int64)
                for d in range(1, reach + 1):
                    left, right = neighbours(c, n, d)
                    counts[d - 1] += np.bincount((left * size + right) * size + c, minlength=size**3)
        for d in range(reach):
            w = np.flatnonzero(counts[d])
            for i in range(0, len(w), 100_000):
                k = w[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), d + 1, np.int32)), pa.array(k), pa.array(counts[d][k])], ["d", "w", "n"])

    return docs.select("text").mapInArrow(run, "d int, w bigint, n bigint").groupBy("d", "w").agg(F.sum("n").alias("n"))


class Network:
    """tanh(left[l] + right[r] + b) @ out + c, softmax over the vocabulary."""

    def __init__(self, size: int, hidden: int, seed: int = 7):
        g = np.random.Generator(np.random.PCG64(seed))
        shapes = [(size, hidden), (size, hidden), (hidden,), (hidden, size), (size,)]
        self.p = [(g.standard_normal(s) * 0.2).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in shapes]
        self.size = size

    def forward(self, left: np.ndarray, right: np.ndarray):
        a, b, bias, out, c = self.p
        h = np.tanh(a[left] + b[right] + bias)
        z = h @ out + c
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, counts: np.ndarray, steps: int, rate: float = 0.03) -> list[float]:
        """counts: (size, size, size) of (left, right, word). Adam on the mean loss of all windows."""
        n = self.size
        c = counts.reshape(n * n, n)
        rows = np.flatnonzero(c.sum(1))
        if not len(rows):
            return []
        left, right, c = rows // n, rows % n, c[rows].astype(np.float32)
        total = c.sum()
        each = c.sum(1, keepdims=True)
        m = [np.zeros_like(x) for x in self.p]
        v = [np.zeros_like(x) for x in self.p]
        losses = []
        for t in range(1, steps + 1):
            h, logp = self.forward(left, right)
            losses.append(float(-(c * logp).sum() / total))
            dz = (np.exp(logp) * each - c) / total
            dh = (dz @ self.p[3].T) * (1 - h * h)
            ga, gb = np.zeros_like(self.p[0]), np.zeros_like(self.p[1])
            np.add.at(ga, left, dh)
            np.add.at(gb, right, dh)
            for i, g in enumerate((ga, gb, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                self.p[i] -= rate * (1 - 0.8 * t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
        return losses

    def table(self) -> np.ndarray:
        """P(class | left, right) for all, flat in the order of the windows' numbers."""
        n = self.size
        grid = np.arange(n * n)
        return np.exp(self.forward(grid // n, grid % n)[1]).astype(np.float32).ravel()


class Model:
    """tables: one for each distance; weights: of the distances in the mixture."""

    def __init__(self, lexicon: Lexicon, tables: list[np.ndarray], weights: tuple[float, ...]):
        self.lexicon, self.tables, self.weights = lexicon, tables, weights

    def log_likelihood(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P(word | window) of the words of texts of n words."""
        c = self.lexicon.classes[ids].astype(np.int64)
        p = np.zeros(len(ids))
        for d, (table, weight) in enumerate(zip(self.tables, self.weights), 1):
            left, right = neighbours(c, n, d)
            p += weight * table[(left * self.lexicon.size + right) * self.lexicon.size + c]
        return np.log(p) + self.lexicon.log_share[ids]


def train(docs: DataFrame, size: int = 128, own: int = 96, hidden: int = 24, steps: int = 120, weights: tuple[float, ...] = (0.8, 0.2)) -> Model:
    """weights: of the distances 1, 2, ... in the mixture; their number is the reach of the window."""
    counts = stored(word_counts(docs), "words")
    x = lexicon(counts, size, own)
    forget(counts)
    rows = stored(windows(docs, x, len(weights)), "windows")
    tables = []
    for d in range(1, len(weights) + 1):
        found = rows.where(F.col("d") == d).toArrow()  # at most size ** 3 rows, of classes
        cells = np.zeros(size**3, np.float64)
        cells[found.column("w").to_numpy()] = found.column("n").to_numpy()
        net = Network(size, hidden)
        net.train(cells.reshape(size, size, size), steps)
        tables.append(net.table())
    forget(rows)
    return Model(x, tables, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(c, ids):
        found, n = ids.of(c["text"])
        total = np.bincount(np.repeat(np.arange(len(n)), n), shared.value.log_likelihood(found, n), len(n))
        return {"doc_id": c["doc_id"], "n_tokens": n, "log_likelihood": total, "mean_log_likelihood": total / np.maximum(1, n)}

    def setup():
        return Ids(shared.value.lexicon)

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, log_likelihood double, mean_log_likelihood double", setup)


def op8(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))

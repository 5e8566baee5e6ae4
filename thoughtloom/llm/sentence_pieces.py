"""Encoding and decoding with a merge-type (BPE) SentencePiece vocabulary.

The encoder keeps a score-ordered agenda of adjacent symbol pairs and merges the best pair (highest
score, leftmost on ties) until none is left; characters outside the vocabulary become byte pieces. No
piece of such a vocabulary has a space mark after another character (checked when the model is read), so no
merge crosses the border of a word: a text falls into words, which are encoded once and remembered in
bounded caches. The new words of an Arrow batch run through the agenda together, one numpy row each
(`Agenda`); long words and texts with runs of spaces fall into chunks that no piece crosses either, and have
an agenda of their own. Every new word, and every text with runs of spaces, is checked against the
sentencepiece library, a batch in one call; a difference stops the job. Decoding is the library's decode(ids).

Defined cases: a null text is an empty one (its ids are the end id alone); repeated rows are encoded
each; very long chunks cost n log n; texts of any size are whole in a task, a row at a time.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MARK = "▁"
NORMAL, BYTE = 1, 6
NEVER = 1 << 30


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Agenda:
    """The agendas of many words of one length at once: a row of symbols and a row of the ranks of its adjacent pairs for each."""

    def __init__(self, ids: dict[str, int], rank: dict[str, int], single: dict[int, int]):
        """single: the pieces of bytes, which stand for the ASCII characters that are no pieces."""
        self.n = n = max(*ids.values(), *single.values()) + 1
        number = ids | {c: n + k for k, c in enumerate(sorted({c for p in ids for c in p} - ids.keys()))}
        self.of = np.full(0x110000, -1, np.int32)
        self.of[:128] = [single[c] for c in range(128)]
        for c, i in number.items():
            if len(c) == 1:
                self.of[ord(c)] = i
        self.rank = np.full(n + 1, NEVER, np.int32)  # the last entry is that of -1, no pair
        pairs = []
        for p, i in ids.items():
            self.rank[i] = rank[p]
            pairs += [(number[p[:k]], number[p[k:]], i) for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self._fill(left << 32 | right, made.astype(np.int32))

    def _fill(self, keys: np.ndarray, made: np.ndarray) -> None:
        """A table of pairs with linear probing."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.made[slot[put]] = keys[put], made[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (keys ^ (keys >> 29)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a pair of symbols makes, -1 if none."""
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.made[slot], -1)
        todo = np.nonzero((there != keys) & (there >= 0))
        while len(todo[0]):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[tuple(t[hit] for t in todo)] = self.made[slot[todo][hit]]
            todo = tuple(t[~hit & (there >= 0)] for t in todo)
        return out

    def encode(self, words: list[str], longest: int) -> list[bytes | None]:
        """Packed ids of each word; None for words longer than that or with characters that are no pieces."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        out: list[bytes | None] = [None] * len(words)
        for n in range(1, longest + 1):
            at = np.flatnonzero(lengths == n)
            if len(at):
                s = symbols[starts[at][:, None] + np.arange(n)]
                known = (s >= 0).all(1)
                for rows, done in self.merge(s[known]):
                    whole = (done < self.n).all(1)
                    packed, width = done[whole].tobytes(), 4 * done.shape[1]
                    for k, i in enumerate(at[known][rows][whole].tolist()):
                        out[i] = packed[k * width : (k + 1) * width]
        return out

    def merge(self, s: np.ndarray):
        """(rows, symbols) of rows with nothing left to merge; every other row merges one pair a round, so all stay equally wide."""
        rows = np.arange(len(s))
        pairs = self.merged(s[:, :-1], s[:, 1:])
        ranks = self.rank[pairs]
        while s.shape[1] > 1 and len(rows):
            each = np.arange(len(rows))
            j = ranks.argmin(1)
            live = ranks[each, j] < NEVER
            if not live.all():
                yield rows[~live], s[~live]
                rows, s, pairs, ranks, j = rows[live], s[live], pairs[live], ranks[live], j[live]
                each = each[: len(rows)]
            s[each, j] = pairs[each, j]
            width = np.arange(s.shape[1] - 1)
            s = np.where(width > j[:, None], s[:, 1:], s[:, :-1])
            before = width[:-1] < j[:, None]
            pairs, ranks = (np.where(before, x[:, :-1], x[:, 1:]) for x in (pairs, ranks))
            for has, left in ((j > 0, j - 1), (j < s.shape[1] - 1, j)):
                r, c = each[has], left[has]
                pairs[r, c] = p = self.merged(s[r, c], s[r, c + 1])
                ranks[r, c] = self.rank[p]
        yield rows, s


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)


class Vocabulary:
    """What is read from the model's file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not m.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        if not n.add_dummy_prefix:
            raise ValueError("a model with a dummy prefix is needed")
        pieces = [p.piece for p in m.pieces if p.type == NORMAL]
        odd = re.escape("".join({c for p in pieces for c in p if re.fullmatch(r"[^\W\d_]", c) and not c.isalpha()}))
        letter = rf"[^\W\d_{odd}]"
        self.chunks = re.compile(rf"{MARK}*{letter}+|{MARK}*(?:(?!{letter})[^{MARK}])+|{MARK}+").findall
        if any(len(self.chunks(p)) > 1 for p in pieces):
            raise ValueError("a piece crosses the border of a chunk: chunks would not be independent")
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        order = {s: r for r, s in enumerate(sorted({p.score for p in m.pieces if p.type == NORMAL}, reverse=True))}
        self.rank = {p.piece: order[p.score] for p in m.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.agenda = Agenda(self.ids, self.rank, self.bytes)
        self.decimals = list(map(str, range(len(m.pieces))))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker: its cache lives on from task to task."""
    return Encoder(path)


class Encoder:
    """ids of texts. cache: the most words to remember, twice over (bounds memory only); together: the longest words that share an agenda."""

    def __init__(self, path: str, cache: int = 300_000, together: int = 32):
        v = vocabulary(path)
        self.chunks, self.ids, self.rank, self.bytes, self.agenda, self.library = v.chunks, v.ids, v.rank, v.bytes, v.agenda, v.library
        self.end, self.decimals = self.library.eos_id(), v.decimals
        self.words: dict[str, bytes] = {}  # packed ids: bytes cost the garbage collector nothing
        self.older: dict[str, bytes] = {}
        self.most, self.together = cache, together

    def chunk(self, text: str) -> list[int]:
        """The agenda over one chunk: a heap of (rank, place); outdated entries are skipped."""
        symbols = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, str]] = []
        rank = self.rank

        def offer(i: int, j: int) -> None:
            if (r := rank.get(pair := symbols[i] + symbols[j])) is not None:
                heapq.heappush(agenda, (r, i, j, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if after[i] != j or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        out: list[int] = []
        for s in filter(None, symbols):
            out += [self.ids[s]] if s in self.ids else map(self.bytes.__getitem__, s.encode("utf-8", "surrogatepass"))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """With the end id, without a start id."""
        if len(self.words) > self.most:
            self.words, self.older = {}, self.words
        known, older, end = self.words, self.older, np.int32(self.end).tobytes()
        parts = [t.split(" ") if t else [] for t in texts]
        spaced = [i for i, p in enumerate(parts) if p and ("" in p or MARK in texts[i])]
        for i in spaced:
            parts[i] = []
        new = set(chain.from_iterable(parts)).difference(known)
        for w in new.intersection(older):
            known[w] = older[w]
        new = list(new.difference(older))
        marked = [MARK + w for w in new]
        found = self.agenda.encode(marked, self.together)
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self.pieces(marked[i])
        self.check(new, found)
        known.update(zip(new, found))
        whole = [self.pieces(MARK + texts[i].replace(" ", MARK)) for i in spaced]
        self.check([texts[i] for i in spaced], whole)
        packed = [b"".join(map(known.__getitem__, p)) for p in parts]
        for i, ids in zip(spaced, whole):
            packed[i] = ids
        return [np.frombuffer(x + end, np.int32).tolist() for x in packed]

    def pieces(self, marked: str) -> bytes:
        """Packed ids of a text whose spaces are marks."""
        return np.fromiter(chain.from_iterable(map(self.chunk, self.chunks(marked))), np.int32).tobytes()

    def check(self, texts: list[str], packed: list[bytes]) -> None:
        library = self.library.encode(texts, num_threads=1) if texts else []
        same = np.array_equal(np.fromiter(map(len, packed), np.int64), 4 * np.fromiter(map(len, library), np.int64))
        if not same or b"".join(packed) != np.fromiter(chain.from_iterable(library), np.int32).tobytes():
            t, own, other = next(x for x in zip(texts, packed, library) if np.frombuffer(x[1], np.int32).tolist() != x[2])
            raise AssertionError(f"{t[:80]!r}: {np.frombuffer(own, np.int32)[:20]} here, {other[:20]} in the library")

    def decimal(self, ids: list[int]) -> str:
        """The ids as decimal numbers, joined by one space."""
        return " ".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def _hex(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded): one row for each row of docs. model: a path, or the public 32k vocabulary."""

    def setup():
        return encoder(model or model_path())

    def run(c, e):
        ids = e.encode(c["text"])
        return {"id": c["id"], "ids": ids, "decoded": e.decode(ids)}

    kind = docs.select(id_col).dtypes[0][1]
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>, decoded string", setup).withColumnRenamed("id", id_col)


def op3(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Counts and digests of encode(), taken in the same pass so that id lists never leave the task."""

    def setup():
        return encoder(model or model_path())

    def run(c, e):
        ids = e.encode(c["text"])
        return {"doc_id": c["doc_id"], "n_tokens": list(map(len, ids)), "ids_sha256": [_hex(e.decimal(x)) for x in ids], "decoded_sha256": list(map(_hex, e.decode(ids)))}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", setup)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: doc_id, source, and the ids with their digests."""

    def setup():  # not kept from task to task: the stages before share the Python workers
        return Encoder(model_path(), cache=50_000)

    def run(c, e):
        ids = e.encode(c["text"])
        return {"doc_id": c["doc_id"], "source": c["source"], "n_tokens": list(map(len, ids)), "ids": ids, "decoded_sha256": list(map(_hex, e.decode(ids)))}

    return map_batches(docs.select("doc_id", "source", "text"), run, "doc_id bigint, source string, n_tokens bigint, ids array<int>, decoded_sha256 string", setup)

"""Language identification in two levels: the family first, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the lower-cased text without digits and ASCII punctuation, square-root
scaled and of length one. Family models are one-versus-rest, language models one-versus-one between the
languages of a family; all are L2-regularised squared-hinge machines fitted in numpy on a bounded sample.
Every document is scored, on its whole text. The score is the product of the family's share of the softmax of
family margins and the share of the language in its family.

Bounds of the sample (the only thing that reaches the driver, 4 KB a row): the `most_langs` labels with the
most documents are learnt, equal ones by name; of each, about `per_lang` documents, and of all about
`most_rows`, chosen by a hash of id and text, of which repeated rows count once.

Defined cases: null texts and texts without a letter are `und` with score 0; without any label everything
is `und`; the family of a label is that of its first part in small letters (`pt-BR`, `EN_us`), a label that
no table of families knows is a family of its own; null ids are not learnt from and count as not held out;
repeated rows are judged each.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: ISO 639-1 codes of languages by family or branch.
FAMILIES = {
    "albanian": ("sq",),
    "armenian": ("hy",),
    "austronesian": ("fj", "haw", "id", "jv", "mg", "mi", "ms", "sm", "su", "tl"),
    "baltic": ("lt", "lv"),
    "bantu": ("ln", "rw", "sn", "sw", "xh", "zu"),
    "celtic": ("br", "cy", "ga", "gd"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "greek": ("el",),
    "indo-aryan": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "sd", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "romance": ("ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "semitic": ("am", "ar", "he", "mt", "ti"),
    "sinitic": ("zh",),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "tai": ("lo", "th"),
    "turkic": ("az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu"),
}
SIZE = 2048
_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family_of(lang: str) -> str:
    code = re.split("[-_]", lang)[0].lower()
    return next((f for f, langs in FAMILIES.items() if code in langs), lang)


def features(text: str) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_KEEP) + b" ", np.uint8).astype(np.uint32)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    x = x[x != 0x202020]
    v = np.bincount((x * np.uint32(2654435761)) >> np.uint32(21), minlength=SIZE).astype(np.float32)
    v = np.sqrt(v)
    n = np.sqrt((v * v).sum())
    return v / n if n else v


def fit(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights (and a bias, last) of a linear machine for y in {-1, 1}; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    at, rate = w.copy(), 1.0 / (1.0 / c + 4.0)
    for t in range(1, steps + 1):  # accelerated gradient
        slack = np.maximum(0, 1 - y * (x @ at))
        new = at - rate * (at / c - 2 * (x.T @ (weight * slack * y)))
        at = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.families = sorted({family_of(a) for a in langs})
        self.langs = {f: sorted({a for a in langs if family_of(a) == f}) for f in self.families}
        of = np.array([family_of(a) for a in langs])
        lang = np.array(langs)
        one = len(self.families) == 1
        self.first = None if one else np.array([fit(x, np.where(of == f, 1.0, -1.0).astype(np.float32)) for f in self.families])
        self.pairs = {}
        for f in self.families:
            own = self.langs[f]
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    m = (lang == a) | (lang == b)
                    self.pairs[a, b] = fit(x[m], np.where(lang[m] == a, 1.0, -1.0).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if self.first is None:
            share = np.ones((len(x), 1))
        else:
            e = np.exp(np.clip(3 * (x @ self.first.T), -30, 30))
            share = e / e.sum(1, keepdims=True)
        pick = share.argmax(1)
        out, score = [""] * len(x), np.zeros(len(x))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(pick == k)
            own = self.langs[f]
            votes = np.full((len(rows), len(own)), 1.0 if len(own) == 1 else 0.0)
            for i, a in enumerate(own):
                for j in range(i + 1, len(own)):
                    p = 1 / (1 + np.exp(-np.clip(3 * (x[rows] @ self.pairs[a, own[j]]), -30, 30)))
                    votes[:, i] += p
                    votes[:, j] += 1 - p
            votes /= max(1, len(own) * (len(own) - 1) / 2)
            best = votes.argmax(1)
            for r, b in zip(rows, best):
                out[r] = own[b]
            score[rows] = share[rows, k] * votes[np.arange(len(rows)), best]
        return out, np.clip(score, 0.0, 1.0)


def held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int = 800, most_langs: int = 200, most_rows: int = 40_000) -> DataFrame:
    """(lang, text) of the labelled documents to learn from, within the bounds."""
    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = counts.orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    each = min(per_lang, most_rows / max(1, len(langs)))
    share = docs.sparkSession.createDataFrame([(r.lang, each / r.n) for r in langs], "lang string, share double")
    key = F.xxhash64("doc_id", "text")
    drawn = seen.select("lang", "text", key.alias("key")).join(F.broadcast(share), "lang")  # most_langs rows at most
    drawn = drawn.where(F.pmod("key", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    return drawn.dropDuplicates(["lang", "key"]).select("lang", "text")


def train(docs: DataFrame, per_lang: int = 800, most_langs: int = 200, most_rows: int = 40_000) -> Model | None:
    """Fits on the sample; None where nothing is labelled."""

    def run(c):
        return {"lang": c["lang"], "x": [features(t).astype(np.float16).tobytes() for t in c["text"]]}

    rows = sorted(map_batches(sample(docs, per_lang, most_langs, most_rows), run, "lang string, x binary").collect())
    if not rows:
        return None
    return Model(np.array([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32), [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; the model travels with the task (some 100 KB)."""

    def run(c):
        texts = c["text"]
        good = [i for i, t in enumerate(texts) if t and model and any(map(str.isalpha, t))]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        for first in range(0, len(good), 512):
            some = good[first : first + 512]
            for i, a, s in zip(some, *model.predict(np.array([features(texts[i]) for i in some]))):
                lang[i], score[i] = a, float(s)
        return {"doc_id": c["doc_id"], "held_out": c["held_out"], "lang_pred": lang, "score": score}

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op10(docs: DataFrame, per_lang: int = 800, most_langs: int = 200, most_rows: int = 40_000) -> DataFrame:
    return identify(docs, train(docs, per_lang, most_langs, most_rows))

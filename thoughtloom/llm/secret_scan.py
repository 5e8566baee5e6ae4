"""Operator 13: secrets in texts, found by keywords and confirmed by patterns and embedded checksums.

One Aho-Corasick automaton passes over a text (letters A-Z lowered) and reports where keywords begin; a rule's
pattern is tried at those positions only, anchored there. Long runs of hexadecimal digits have no keyword, so a second
automaton looks for one run of thirteen equal symbols in the text with every such digit replaced by `0`. Kinds whose
form carries a checksum (access tokens with a CRC32, extended keys with a double SHA-256, payment cards with Luhn's
digit) keep a match only if the checksum holds.

Within a kind matches are leftmost and do not overlap; a base match that is too short is dropped but still takes its
text, as a scan with the plain pattern does. Null and empty texts have no spans; repeated rows and rows without an id
are judged one by one; other columns are ignored. Positions are code points, ends exclusive. A text's work is linear in
its length and no row meets another, so hot sources or copies need no care.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Names and digits of the public token formats.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
RUN = 13
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def number(digits: str, alphabet: str) -> int:
    value = 0
    for d in digits:
        value = value * len(alphabet) + alphabet.index(d)
    return value


def crc_holds(token: str) -> bool:
    """The last six characters are the CRC32, in base 62, of the characters between the prefix and them."""
    body = token[token.index("_") + 1 :]
    return number(body[-6:], BASE62) == zlib.crc32(body[:-6].encode())


def base58_holds(key: str) -> bool:
    """82 bytes in base 58, of which the last four begin the double SHA-256 of the others."""
    value = number(key, BASE58)
    if value >> (8 * 82):
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def luhn_holds(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += sum(divmod(2 * d, 10)) if i % 2 else d
    return total % 10 == 0


@dataclass(frozen=True)
class Rule:
    """A kind: where to look (keywords in lower case; none: runs of hexadecimal digits), what must stand there, and whether to keep it."""

    kind: str
    keywords: tuple[str, ...]
    pattern: str
    keep: Callable[[re.Match], bool]


#: In the order in which spans that begin together are listed; the first three are the base.
RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        lambda m: len(m[2]) >= 8,
    ),
    Rule("access", ("akia",), r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    Rule("hex", (), r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: crc_holds(m[0])),
    Rule("npm", ("npm_",), r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: crc_holds(m[0])),
    Rule("xprv", ("xprv",), r"(?<![A-Za-z0-9])xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])", lambda m: base58_holds(m[0])),
    Rule("card", (), r"(?<![A-Za-z0-9])(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6011[0-9]{12})(?![A-Za-z0-9])", lambda m: luhn_holds(m[0])),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """The automatons and compiled patterns of a task."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        import ahocorasick

        self.rules = rules
        self.patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.words, self.runs = ahocorasick.Automaton(), ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for w in r.keywords:
                owners.setdefault(w, []).append(i)
        for w, mine in owners.items():
            self.words.add_word(w, (len(w), mine))
        self.runs.add_word("0" * RUN, RUN)
        for a in (self.words, self.runs):
            a.make_automaton()
        self.run_rules = [i for i, r in enumerate(rules) if not r.keywords]
        self.digits = bytes(ord("0") if chr(c) in "0123456789abcdef" else c for c in range(256))

    def hits(self, text: str) -> dict[int, list[int]]:
        """For each rule the positions at which its pattern may begin. Bytes are mapped, so that code points keep their places."""
        raw = text.encode("utf-8", "surrogatepass")
        found: dict[int, list[int]] = {}
        if self.words:
            for end, (size, mine) in self.words.iter(raw.lower().decode("utf-8", "surrogatepass")):
                for i in mine:
                    found.setdefault(i, []).append(end - size + 1)
        last = -2
        for end, size in self.runs.iter(raw.translate(self.digits).decode("utf-8", "surrogatepass")) if self.run_rules else ():
            if end != last + 1:  # the first hit of a run begins it
                for i in self.run_rules:
                    found.setdefault(i, []).append(end - size + 1)
            last = end
        return found

    def spans(self, text: str | None) -> list[dict]:
        out = []
        for i, starts in self.hits(text).items() if text else ():
            free = 0
            for s in sorted(starts):
                m = self.patterns[i].match(text, s) if s >= free else None
                if m:
                    free = m.end()
                    if self.rules[i].keep(m):
                        out.append((s, i, free))
        return [{"kind": self.rules[i].kind, "start": s, "end": e} for s, i, e in sorted(out)]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): for each row of docs (doc_id, text) all spans by start, then by the order of `rules`."""
    return map_batches(
        docs.select(F.col("doc_id").cast("bigint"), "text"),
        lambda b, scanner: {"doc_id": b["doc_id"], "spans": [scanner.spans(t) for t in b["text"]]},
        f"doc_id bigint, spans {SPAN}",
        setup=lambda: Scanner(rules),
    )


def listed(spans: Column) -> Column:
    """`kind:start:end` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13(docs: DataFrame) -> DataFrame:
    """Per row: counts of the three base kinds, the digest of the base spans, all spans; n_checked are those with a checksum."""
    count = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("bigint")
    return scan(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count(*[r.kind for r in RULES if r.kind not in BASE]).alias("n_checked"),
    )

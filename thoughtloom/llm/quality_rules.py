"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document; the ledger keeps the measurements and one bit for each
rule that failed. Policies are versioned sets of rules: a policy rejects a document when
(bits & mask) has `at_least` bits. Ablations come from bitwise aggregation over the ledger alone, so a
new policy, or the question what a rule adds, never reads a text again.

Defined cases: a null or empty text has no words and all counts 0 (it fails `few_words`); a null doc_id
stays as it is; repeated rows are judged each on its own; other columns of the input are ignored; a very long
text is whole in one task, in a few times its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, words_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, dup_line_chars long, n_repeat_words long, n_marks long, n_letters long, n_upper long"


@dataclass(frozen=True)
class Rule:
    """Fails where `fails` holds. The bit is the rule's place in RULES; rules are only ever appended."""

    name: str
    fails: Column


def rules(prefix: str = "") -> list[Rule]:
    """prefix: of the measurement columns' names."""

    def c(name: str) -> Column:
        return F.col(prefix + name)

    def _share(n: str, of: str, percent: int) -> Column:
        return c(n) * 100 > c(of) * percent

    return [
        Rule("few_words", c("n_words") < 10),
        Rule("repeated_windows", _share("n_repeat_words", "n_words", 20)),
        Rule("short_words", c("word_chars") < 2 * c("n_words")),
        Rule("long_words", c("word_chars") > 20 * c("n_words")),
        Rule("symbols", _share("n_symbols", "n_words", 30)),
        Rule("duplicate_lines", (c("n_dup_lines") >= 2) & _share("n_dup_lines", "n_lines", 30)),
        Rule("duplicate_line_chars", (c("n_dup_lines") >= 2) & _share("dup_line_chars", "word_chars", 30)),
        Rule("shouting", (c("n_letters") >= 50) & _share("n_upper", "n_letters", 40)),
        Rule("exclamations", (c("n_marks") >= 10) & _share("n_marks", "n_words", 30)),
        Rule("few_letters", c("n_letters") * 2 < c("word_chars")),
    ]


#: Versioned policies: the names of the rules that count, and how many of them must fail.
POLICIES: dict[str, tuple[tuple[str, ...], int]] = {
    "base": (("few_words", "repeated_windows"), 1),
    "v1": (("few_words", "repeated_windows", "short_words", "long_words", "symbols", "duplicate_lines", "duplicate_line_chars", "shouting", "exclamations", "few_letters"), 1),
    "v1_lenient": (("few_words", "repeated_windows", "short_words", "long_words", "symbols", "duplicate_lines", "duplicate_line_chars", "shouting", "exclamations", "few_letters"), 2),
}


def _measure(text: str | None) -> tuple:
    words = words_of(text)
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)) if text else 0, 0, 0, 0, 0, 0, 0, 0)
    chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dup = dup_chars = 0
    for line in text.split("\n"):
        if not line.strip(SPACES):
            continue
        lines += 1
        if line in seen:
            dup += 1
            dup_chars += len(line) - sum(map(line.count, SPACES))
        else:
            seen.add(line)
    letters = sum(map(str.isalpha, text)) if text.isascii() is False else None
    if letters is None:
        letters = len(text.translate(_NOT_LETTERS))
    lower = text.lower()
    if text == lower:
        upper = 0
    elif len(lower) == len(text):
        upper = sum(a != b for a, b in zip(text, lower))
    else:  # a letter whose small form is longer
        upper = sum(a != a.lower() for a in text)
    return (len(words), chars, n_symbols, lines, dup, dup_chars, _repeated(words), text.count("!"), letters, upper)


_NOT_LETTERS = {i: None for i in range(128) if not chr(i).isalpha()}


def _repeated(words: list[bytes], n: int = 5) -> int:
    """Words that lie in an n-word window found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(windows) < 2 or len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    twice = set()
    for i, w in enumerate(windows):
        if first.setdefault(w, i) != i:
            twice.add(w)
    count, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            count += i + n - max(i, end)
            end = i + n
    return count


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed): one row for each row of docs; failed holds a bit for each failed rule."""

    def run(c):
        return {"id": c["id"]} | _columns(_NAMES, c["text"])

    kind = docs.select(id_col).dtypes[0][1]
    m = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, {MEASURES}")
    return m.withColumnRenamed("id", id_col).withColumn("failed", _bits())


_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def _columns(names: list[str], texts: list) -> dict[str, list]:
    return dict(zip(names, map(list, zip(*map(_measure, texts)))))


def _bits(prefix: str = "") -> Column:
    return sum((F.when(r.fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules(prefix))), F.lit(0)).cast("bigint")


def mask(policy: str) -> int:
    names = [r.name for r in rules()]
    return sum(1 << names.index(n) for n in POLICIES[policy][0])


def verdict(policy: str, failed: str | Column = "failed") -> Column:
    """True where the policy keeps the document."""
    c = F.col(failed) if isinstance(failed, str) else failed
    return F.bit_count(c.bitwiseAND(F.lit(mask(policy)))) < POLICIES[policy][1]


def ablations(led: DataFrame) -> DataFrame:
    """(policy, rule, n_docs, n_failed, n_rejected, n_only): rejected by the policy, and by it only because of this rule.

    The ledger shrinks to counts of distinct bit patterns first (at most 2^rules rows), so this costs
    one partial aggregation at any size.
    """
    patterns = led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    names = [r.name for r in rules()]
    rows = [(p, r, mask(p), 1 << names.index(r), POLICIES[p][1]) for p in POLICIES for r in POLICIES[p][0]]
    grid = led.sparkSession.createDataFrame(rows, "policy string, rule string, mask bigint, bit bigint, at_least int")
    hit = F.bit_count(F.col("failed").bitwiseAND(F.col("mask")))
    without = F.bit_count(F.col("failed").bitwiseAND(F.col("mask")).bitwiseAND(F.bitwise_not("bit")))
    n = F.col("n")
    return (
        patterns.join(F.broadcast(grid))
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit >= F.col("at_least"), n).otherwise(0)).alias("n_rejected"),
            F.sum(F.when((hit >= F.col("at_least")) & (without < F.col("at_least")), n).otherwise(0)).alias("n_only"),
        )
    )


def op4(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept; a document that fails the base policy is never kept."""
    led = ledger(docs)
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict("base")).alias("base_failed"), (verdict("base") & verdict(policy)).alias("kept"), "failed",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base policy and policy v1 keep, with all their columns.

    The verdict is joined to the row by its place in the same pass: text and measurements travel together.
    """
    columns = docs.columns
    names = [f"_m_{n}" for n in _NAMES]

    def run(c):
        return {k: c[k] for k in columns} | _columns(names, c["text"])

    judged = map_batches(docs, run, ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [f"{m} long" for m in names]))
    failed = _bits("_m_")
    return judged.where(verdict("base", failed) & verdict("v1", failed)).select(*columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, k, list(i) AS places FROM g GROUP BY 1, 2 HAVING count(*) > 1)), range(5) o(j) GROUP BY 1),
l AS (SELECT doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS dup, sum((n - 1) * c)::BIGINT AS dup_chars FROM (SELECT doc_id, x, c, count(*) AS n FROM l GROUP BY 1, 2, 3) GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_chars, 0) AS dup_chars,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}\p{Lt}]', '', 'g')) AS n_upper
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id),
f AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT + 8 * (word_chars > 20 * n_words)::BIGINT + 16 * (n_symbols * 100 > n_words * 30)::BIGINT
    + 32 * (n_dup_lines >= 2 AND n_dup_lines * 100 > n_lines * 30)::BIGINT + 64 * (n_dup_lines >= 2 AND dup_chars * 100 > word_chars * 30)::BIGINT + 128 * (n_letters >= 50 AND n_upper * 100 > n_letters * 40)::BIGINT
    + 256 * (n_marks >= 10 AND n_marks * 100 > n_words * 30)::BIGINT + 512 * (n_letters * 2 < word_chars)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

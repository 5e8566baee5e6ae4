"""The scalar vocabulary: column expressions that every operator shares (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: str | Column) -> Column:
    """Lower case without outer spaces: how names are compared."""
    return F.lower(F.trim(col(c)))


def contains(c: str | Column, s: str | Column) -> Column:
    return F.contains(F.lower(col(c)), F.lower(s if isinstance(s, Column) else F.lit(s)))


def cut(c: str | Column, n: int, mark: str = "") -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def filled(c: str | Column) -> Column:
    """NULL where null or blank."""
    c = col(c)
    return F.when(F.length(F.trim(c)) > 0, c)


def first_filled(*cs: str | Column) -> Column:
    return F.coalesce(*map(filled, cs))


def find_all(c: str | Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def replace_all(c: str | Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col(c), pattern, by)


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def words(c: str | Column) -> Column:
    return F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")


def any_match(array: str | Column, test) -> Column:
    return F.exists(col(array), test)


def jaccard(a: str | Column, b: str | Column) -> Column:
    a, b = col(a), col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def clamp(c: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def half_even(c: str | Column, places: int) -> Column:
    return F.bround(col(c), places)


def parse_time(c: str | Column) -> Column:
    """ISO-8601 text to a timestamp, NULL where it is none."""
    return F.try_to_timestamp(F.regexp_replace(col(c), "Z$", "+00:00"))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole elapsed days (86400 s each), rounded down."""
    return F.floor(F.timestamp_diff("SECOND", col(earlier), col(later)) / 86400).cast("bigint")


def period(c: str | Column, granularity: str) -> Column:
    """day 2024-01-31, week 2024-W05 (ISO), month 2024-01."""
    c = col(c)
    if granularity == "week":
        thursday = F.date_add(F.date_trunc("week", c).cast("date"), 3)
        return F.concat(F.date_format(thursday, "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
    return F.date_format(c, {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[granularity])


def hash_id(c: str | Column) -> Column:
    """h: and 8 digits of the SHA-256, for correlation without the value."""
    c = col(c)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit("h:empty")).otherwise(F.concat(F.lit("h:"), F.substring(F.sha2(c, 256), 1, 8)))


def is_uuid(c: str | Column) -> Column:
    return F.lower(col(c)).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def tokens(c: str | Column, plus: int = 0) -> Column:
    return (F.floor(F.length(col(c)) / 4) + plus).cast("bigint")


def stem(c: str | Column) -> Column:
    return F.regexp_extract(col(c), r"([^/]*?)(\.[^./]*)?$", 1)


def extension(c: str | Column) -> Column:
    return F.regexp_extract(col(c), r"[^/](\.[^./]+)$", 1)


def lcs_length(a: str | Column, b: str | Column) -> Column:
    """Length of the longest common subsequence, one row of the table at a time.

    The row is an array of len(b) + 1 numbers; each character of a folds it into the next row.
    """
    a, b = col(a), col(b)
    chars = F.filter(F.split(b, ""), lambda x: x != "")
    row = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def next_row(old: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda new, j: F.array_append(
                new,
                F.when(F.get(chars, j - 1) == ch, F.get(old, j - 1) + 1).otherwise(F.greatest(F.get(old, j), F.get(new, j - 1))),
            ),
        )

    full = F.aggregate(F.filter(F.split(a, ""), lambda x: x != ""), row, next_row, lambda r: F.element_at(r, -1))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(full)


def char_places(c: str | Column) -> Column:
    """Each character of a text of 1 to 62 characters with its places as bits: map<string, bigint>."""
    c = col(c)
    chars = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1))))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    places = lambda x: F.aggregate(F.sequence(F.lit(0), F.length(c) - 1), F.lit(0).cast("bigint"), lambda s, i: s + F.when(F.substring(c, i + 1, F.lit(1)) == x, bit(i)).otherwise(F.lit(0).cast("bigint")))
    return F.map_from_arrays(chars, F.transform(chars, places))


def lcs_of_places(places: str | Column, n: Column, b: str | Column) -> Column:
    """lcs_length of a text of n <= 62 characters, given its char_places, and a text b that is not empty: a step for each character of b."""
    places, b = col(places), col(b)
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - F.lit(1).cast("bigint")

    def step(v: Column, ch: Column) -> Column:
        met = v.bitwiseAND(F.coalesce(F.try_element_at(places, ch), F.lit(0).cast("bigint")))
        return (v + met).bitwiseOR(v - met).bitwiseAND(full)

    chars = F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.substring(b, i, F.lit(1)))
    return n - F.bit_count(F.aggregate(chars, full, step))


def indel_ratio(a: str | Column, b: str | Column) -> Column:
    """100 * 2 * LCS / (len a + len b): similarity of names, 100 for two empty ones."""
    a, b = col(a), col(b)
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / both)


def may_reach(a: str | Column, b: str | Column, percent: float | Column) -> Column:
    """False only where the indel ratio is surely below percent: a cheap, lossless filter before lcs_length.

    The indel distance is (1 - ratio) * (len a + len b) and never under the Levenshtein distance.
    """
    a, b = col(a), col(b)
    share = 1 - percent / 100 + 1e-9
    most = F.floor((share if isinstance(share, Column) else F.lit(share)) * (F.length(a) + F.length(b))).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= most)

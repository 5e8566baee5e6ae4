"""An inverted index of texts: made once, stored in buckets of terms, extended by new documents, ranked by BM25."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import settled

SEPARATORS = r"[^\p{L}\p{N}]+"
#: Addends of scores that a task sums.
PART_ROWS = 2_000_000


def words_of(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


@dataclass(frozen=True)
class Postings:
    """terms (term, id, tf, length) of documents, the number of those with words or without, and their mean length."""

    terms: DataFrame
    counted: DataFrame  # (n, words, filled): one row


def postings(docs: DataFrame, fields: list[str]) -> Postings:
    """An index for one use: every text is cut once; documents repeat neither ids nor texts here."""
    words = _cut(docs, fields)
    return Postings(_terms(words), _counted(words))


def _cut(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(id, words, length): all words of the fields, sorted."""
    words = docs.select("id", F.sort_array(F.flatten(F.array(*[words_of(c) for c in fields]))).alias("words"))
    return words.withColumn("length", F.size("words").cast("bigint"))


def _terms(words: DataFrame) -> DataFrame:
    """(term, id, tf, length) of sorted words: a term's count is the distance to the next term's place, so nothing is grouped."""
    new = lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))
    places = words.where("length > 0").withColumn("places", F.filter(F.sequence(F.lit(0), F.size("words") - 1), new))
    term = lambda i, k: F.struct(F.get("words", i).alias("term"), (F.coalesce(F.get("places", k + 1), F.size("words")) - i).alias("tf"))
    return places.select("id", "length", F.explode(F.transform("places", term)).alias("x")).select("x.term", "id", "x.tf", "length")


def _counted(words: DataFrame) -> DataFrame:
    return words.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words"), F.count_if(F.col("length") > 0).alias("filled"))


def rank(queries: DataFrame, index: Postings, k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score, rank): the k best documents of each query (id, text) by BM25 over its distinct terms.

    The queries' terms meet the index before anything is shuffled; document frequencies are counted on what is left.
    Then a document's postings go to one task, and tasks are as many as the sums have addends / PART_ROWS, so no task's
    table of sums grows with the documents; only a task's k best of a query leave it.
    """
    asked = settled(queries.select(F.col("id").alias("query"), F.explode(F.array_distinct(words_of("text"))).alias("term")))
    # a checked size: so many short words are some tens of MB at most; beyond it the joins shuffle
    small = asked.count() <= 500_000
    few = F.broadcast if small else lambda df: df
    used = settled(index.terms.join(few(asked.select("term").distinct()), "term", "left_semi").select("term", "id", "length", "tf"))
    df = settled(asked.join(used.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term"))
    parts = -(-(df.agg(F.sum("df")).head()[0] or 1) // PART_ROWS)
    # one row as a scalar subquery: nothing runs while the query is planned
    stats = index.counted.select(F.struct("n", (F.col("words") / F.col("filled")).alias("mean")).alias("stats")).scalar()
    gain = F.log(1 + (F.col("stats.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = gain * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("stats.mean")))
    met = used.repartition(parts, "id").join(few(df), "term") if small else used.join(df, "term").repartition(parts, "id")
    weights = met.withColumn("stats", stats).select("query", "id", weight.alias("w"))
    score = weights.groupBy("query", "id").agg(F.sum("w").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class TextIndex:
    """A stored index below `path`: batches of postings by bucket of the term, sizes of batches, and the texts for substrings.

    add() appends a batch of new documents under its number; adding a number again replaces it, so a repeated run
    changes nothing. A term's postings of all batches lie in one bucket folder, and a search reads only the buckets of
    its terms where it names few. Ids must be new; a changed document is a new batch under its old number.
    """

    def __init__(self, spark: SparkSession, path: str, fields: list[str], buckets: int = 64):
        self.spark, self.path, self.fields, self.buckets = spark, path, fields, buckets

    def _bucket(self, term: str | Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, number: int) -> None:
        words = _cut(docs, self.fields)
        # a frequent term's bucket is cut into several tasks
        terms = _terms(words).withColumn("bucket", self._bucket("term")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        terms.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/batch={number}")
        text = F.concat_ws("\n", *self.fields)
        docs.select("id", text.alias("text")).write.mode("overwrite").parquet(f"{self.path}/texts/batch={number}")
        _counted(words).write.mode("overwrite").parquet(f"{self.path}/sizes/batch={number}")

    def read(self, terms: DataFrame | None = None) -> Postings:
        """The whole index; terms: only the buckets of these (term), for a bounded list of asked terms."""
        found = self.spark.read.schema("term string, id bigint, length bigint, tf int, batch int, bucket int").parquet(f"{self.path}/terms")
        if terms is not None:
            asked = [r.bucket for r in terms.select(self._bucket("term").alias("bucket")).distinct().collect()]  # at most `buckets` rows
            found = found.where(F.col("bucket").isin(asked))
        sizes = self.spark.read.schema("n bigint, words bigint, filled bigint, batch int").parquet(f"{self.path}/sizes")
        return Postings(found.select("term", "id", "length", "tf"), sizes.agg(*[F.sum(c).alias(c) for c in ("n", "words", "filled")]))

    def texts(self) -> DataFrame:
        return self.spark.read.schema("id bigint, text string, batch int").parquet(f"{self.path}/texts").select("id", "text")

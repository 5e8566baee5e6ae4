"""The corpus pipeline: quality rules, near-duplicates, repeated strings, source mixing, sentence pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written
as Parquet to the shared folder and read again as the next one's docs. All but the last return the columns
of documents. A stage judges its own input: the mixture is over what the stages before it kept, and ids
repeat from there on where a source is passed more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thoughtloom.llm import minhash_dedup, quality_rules, sentence_pieces, source_mix, suffix_dedup
from thoughtloom.llm.common import stored, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("minhash_dedup", minhash_dedup.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("source_mix", source_mix.stage),
    ("sentence_pieces", sentence_pieces.stage),
]

#: SQL cannot express signatures, suffix arrays or merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

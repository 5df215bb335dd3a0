"""A corpus made ready for training: language, exact and near copies, mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result
is written as Parquet and read again as the next one's docs.  All stages but the last return
the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.llm import exact_dedup, language_id, mixing, ngram_join, packing
from ledgerwake.llm.queries import WORD_BPE
from ledgerwake.llm.shared import held_out, importable, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the others go."""
    importable(spark)
    learnt = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"), 4))
    return language_id.keep_known(docs, language_id.fit(learnt))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest id."""
    importable(spark)
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources holds them: never, once, or up to three times."""
    return mixing.deal(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    importable(spark)
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packed", packed),
]

# No SQL can state what the language model learns; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs

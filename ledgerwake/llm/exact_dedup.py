"""Exact duplicates: one class per text that is equal after folding white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwake.llm.shared import SPACES, staged


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def md5_bytes(text: Column) -> Column:
    """128-bit content hash."""
    return F.unhex(F.md5(text))


def resolve(docs: DataFrame, content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Rows are grouped by hash and text together, so equal hashes of different texts are
    told apart byte by byte.  The grouping is combined before the shuffle: a text copied
    any number of times leaves each task once.  The second pass attaches the classes by
    hash alone, with narrow rows; only hashes that hold several texts (collisions) are
    attached by hash and text.

    Null text counts as empty.  The smallest id stays; a null id counts as the largest,
    so it stays only where all ids of a text are null, and keep_id is then null.  Rows
    that repeat an id are the same document: they are kept or dropped together.  An empty
    table gives an empty result; further columns are ignored.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    rows = rows.select("doc_id", "body", content_hash(F.col("body")).alias("hash"))
    classes = staged(_classes(rows).select("hash", "keep_id", "group_size"), "dedup")
    collided = classes.groupBy("hash").count().filter("count > 1").select("hash")
    narrow = rows.select("doc_id", "hash", F.unhex(F.sha2("body", 256)).alias("digest"))
    if collided.isEmpty():
        return _result(narrow.join(classes, "hash"))
    clear = narrow.join(collided, "hash", "left_anti").join(classes, "hash")
    mixed = rows.join(collided, "hash", "left_semi")
    apart = mixed.join(_classes(mixed), ["hash", "body"]).withColumn(
        "digest", F.unhex(F.sha2("body", 256))
    )
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    return _result(clear.select(columns).unionByName(apart.select(columns)))


def _classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hash", "body").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one per text, with all their columns.

    Of rows that repeat the kept id and its text one stays, the smallest by its other columns
    (of rows whose texts differ in white space, the one with the smallest text).
    """
    resolved = resolve(docs).filter("kept")
    kept = resolved.groupBy("doc_id", "text_sha256").agg(F.max("group_size").alias("_size"))
    kept = kept.toDF("_a", "_b", "_size")
    digest = F.sha2(normalised(docs["text"]), 256)
    same = docs["doc_id"].eqNullSafe(kept["_a"]) & (digest == kept["_b"])
    rows = docs.join(kept, same).drop("_a")
    # Only texts met more than once can have repeated rows; a struct's minimum is combined
    # before the shuffle, so a row repeated any number of times leaves each task once.
    alone = rows.filter("_size = 1").select(docs.columns)
    row = F.struct("text", *(c for c in docs.columns if c != "text"))
    first = rows.filter("_size > 1").groupBy("doc_id", "_b").agg(F.min(row).alias("_row"))
    return alone.unionByName(first.select(*(F.col("_row")[c].alias(c) for c in docs.columns)))


SQL = r"""
WITH bodies AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
    FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM bodies
"""

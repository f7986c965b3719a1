"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, y) of at most `rows` labelled documents outside the held-out fold, those with the smallest hash of their id.

    Rows without id, text or label are left out; a document with two different labels counts with both. The bound holds
    for the ids that are broadcast and, after the join, for the rows that come out, so a repeated id cannot widen it.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(1))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    picked = known.distinct().orderBy(order, "y").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(picked), "doc_id").select(order.alias("h"), "text", "y")

"""Labelled rows for the classifiers: which rows may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of labelled documents a classifier is fitted on, at most. Scoring and all else covers every row.
MAX_ROWS = 10_000


def held_out(id: Column) -> Column:
    """A fifth of the ids, by the CRC-32 of the id as text; false for a null id."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = MAX_ROWS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most ``rows`` rows of labelled ids outside the held-out fifth, the same rows on every run.

    Null ids and null labels are left out; an id labelled several times counts once, as 1 if half of its labels or more
    are. Equal rows of an id count once, its other texts again; where that would be over ``rows``, every sampled id has one
    text before any has a second. What is broadcast is bounded by ``rows``.
    """
    known = labels.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{label}`").cast("double").alias("_label")).filter("_id IS NOT NULL AND _label IS NOT NULL")
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg((F.avg("_label") >= 0.5).cast("int").alias("label"))
    sample = F.xxhash64(F.lit("sample"), "_id")
    few = known.orderBy(sample, "_id").limit(rows)
    texts = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("text"))
    mine = texts.join(F.broadcast(few), "_id").withColumn("_hash", F.xxhash64("text"))
    each = mine.select("_id", "_hash").distinct()
    first = each.groupBy("_id").agg(F.min("_hash").alias("_first"))
    picked = each.join(F.broadcast(first), "_id").orderBy(F.col("_hash") != F.col("_first"), sample, "_id", "_hash").limit(rows).select("_id", "_hash")
    found = mine.join(F.broadcast(picked), ["_id", "_hash"]).groupBy("_id", "_hash").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return found.select("text", "label")

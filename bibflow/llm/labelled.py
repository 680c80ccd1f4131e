"""Bounded samples of labelled documents, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``label`` (0 or 1) of at most ``rows`` labelled documents that are not held out.

    They are those with the smallest hash of their id, so the sample depends on
    nothing but the labels. The list of ids is bounded and is sent to the
    documents. Null ids and labels take no part; of repeated labels the largest counts, and of
    documents with one id the smallest text, so there are never more rows than ids.
    """
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(
        "doc_id", "text", "label")

"""Labelled documents: all of them, or bounded, reproducible samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklore.llm.common import fold, sample_mark, sampled

#: Label rows that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 400_000


def known_labels(labels: DataFrame, label: str, parts: int) -> DataFrame:
    """(id, y) of the usable labels outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    return known.where(fold(F.col("id"), parts) != 0)


def all_labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, parts: int = 5) -> DataFrame:
    """(doc_id, text, y, picked) of every labelled document outside the held-out fold.

    ``picked`` marks the rows of ``labelled_texts``'s sample.
    """
    known = known_labels(labels, label, parts)
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    known = known.withColumn("picked", sample_mark(F.col("id"), bound, counts, F.col("y")))
    known = F.broadcast(known) if sum(counts.values()) <= BROADCAST_ROWS else known
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(known, F.col("doc_id") == F.col("id")).select("doc_id", "text", "y", "picked")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, parts: int = 5) -> DataFrame:
    """(doc_id, text, y) of about ``bound`` labelled documents per class outside the held-out fold.

    The sample is drawn from the label table; at most ``2 * bound`` ids and
    labels in expectation, so joining them by broadcast is safe at any size and
    no text is shuffled.
    """
    known = sampled(known_labels(labels, label, parts), F.col("id"), bound, F.col("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.session import gathered, materialize, prepare

__all__ = ["fold", "free_name", "gathered", "give_back", "keyed_docs", "materialize", "sample_mark", "sampled", "spread", "table", "text_key", "tidy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """The fixed fold of a document: crc32 of its id as text, modulo ``parts``."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts).cast("int")


def sample_mark(key: Column, bound: int, counts: dict, classes: Column | None = None) -> Column:
    """True for about ``bound`` rows (per class, of which there are ``counts``): those whose hash is in the lowest part of the hash space."""
    label = F.lit(0) if classes is None else classes
    space = 1 << 40
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(label.eqNullSafe(F.lit(value)), F.lit(min(space, space * bound // max(n, 1)))).otherwise(share)
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(space)) < share


def sampled(rows: DataFrame, key: Column, bound: int, classes: Column | None = None) -> DataFrame:
    """A sample of about ``bound`` rows (per class), the same on every run.

    Nothing is sorted or gathered, only the row counts per class come to the driver.
    """
    label = F.lit(0) if classes is None else classes
    counts = {r[0]: r[1] for r in rows.groupBy(label.alias("c")).count().collect()}
    return rows.where(sample_mark(key, bound, counts, classes))


def text_key(text: Column) -> Column:
    """A 64-bit key of a text; with the document's id it names a row's content."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def keyed_docs(docs: DataFrame) -> DataFrame:
    """Id, text and text key; rows equal in all three are one document repeated."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))


def free_name(df: DataFrame, base: str = "_row") -> str:
    """A column name the table does not have."""
    while base.lower() in {c.lower() for c in df.columns}:
        base += "_"
    return base


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out over the session's shuffle partitions, by keys if given."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def give_back() -> None:
    """Return to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work):
    """``work`` for mapInArrow; what a task freed goes back to the system, not to the worker's next task of another kind."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run

"""The incremental load as a stream: land, score, filter, chunk, route, store.

Each micro-batch adds what changed as a run of its own to the stored tables
(`runs`), which merges runs of like size; it reads the runs of earlier batches
only, and of those only the ids it has itself.  The index is the latest text
and the latest metadata per id over all runs; ``compact`` folds them into one
table for searching.

Texts are moved as rarely as can be.  What is known of a document, its hash and
the hashes of its stored chunks, comes to the landed rows in one join, and
chunks are cut and routed where that leaves them.  A chunk is stored once, with
its header beside it; ``indexed`` is put together when rows are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklore.functions.text import doc_hash
from worklore.operators.chunks import explode_chunks, header_of, indexed_text
from worklore.operators.upsert import latest
from worklore.functions.text import content_hash
from worklore.session import fresh_path, materialize, spread_small
from worklore.streaming.runs import Runs

TEXT_COLS = ["chunk", "_header", "content_hash"]
_KEYS = ["id", "route", "batch"]


def _as_is(docs: DataFrame) -> DataFrame:
    return docs


def _latest_hashes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "id").agg(F.max_by("hash", "batch").alias("hash"), F.max("batch").alias("batch"))


def _latest_rows(rows: DataFrame, *also: str) -> DataFrame:
    """One row per id (with columns ``also`` that belong to it): the latest metadata beside the latest text.

    Ids are nearly all distinct within a file, so rows are sorted after the shuffle only.
    """
    meta = [c for c in rows.columns if c not in (*_KEYS, *TEXT_COLS, *also)]
    full = F.col("route") == "full"
    last = rows.repartition(*(also or ["id"])).groupBy("id", *also).agg(
        F.max("batch").alias("batch"),
        F.max_by(F.struct(*meta), "batch").alias("_m"),
        F.max_by(F.when(full, F.struct(*TEXT_COLS)), F.when(full, F.col("batch"))).alias("_t"),
    )
    return last.select("id", *also, "batch", F.when(F.col("_t").isNotNull(), "full").otherwise("meta").alias("route"), "_m.*", "_t.*")


def _with_indexed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("indexed", indexed_text(F.col("_header"), F.col("chunk"))).drop("_header")


@dataclass
class IncrementalJob:
    """One load job: landed documents in, index and hash tables out."""

    spark: SparkSession
    base: str
    hash_of: list[str]
    score: Callable[[DataFrame], DataFrame] = _as_is
    cursor: str = "updated_at"

    def land(self, docs: DataFrame) -> None:
        """Put a page of normalised documents where the stream finds it."""
        spread_small(docs, "id").write.mode("append").parquet(f"{self.base}/landing")
        self.schema = docs.schema

    @property
    def stored(self) -> Runs:
        return Runs(self.spark, self.base, {"hashes": _latest_hashes, "index": _latest_rows})

    def hashes(self, batch: int = 1 << 30, only: DataFrame | None = None) -> DataFrame | None:
        """(source, id, hash) of the documents loaded before; ``only`` those with these (source, id)."""
        rows = self.stored.read("hashes", batch)
        if rows is None:
            return None
        return _latest_hashes(rows if only is None else rows.join(only, ["source", "id"], "left_semi")).drop("batch")

    def _known(self, batch: int, page: DataFrame) -> DataFrame | None:
        """(id, _hashes, _texts): what is stored of the documents of a page, its hash by source and its chunks' hashes by id; no text is read."""
        ids = page.select("id").distinct()
        hashes = self.hashes(batch, page.select("source", "id"))
        rows = self.stored.read("index", batch)
        if hashes is None or rows is None:
            return None
        texts = rows.filter("route = 'full'").select(F.coalesce("parent_doc_id", "id").alias("_doc"), "id", "content_hash", "batch")
        texts = texts.join(ids.withColumnRenamed("id", "_doc"), "_doc", "left_semi").groupBy("_doc", "id").agg(F.max_by("content_hash", "batch").alias("content_hash"))
        by_source = hashes.groupBy("id").agg(F.collect_list(F.struct("source", "hash")).alias("_hashes"))
        by_doc = texts.groupBy(F.col("_doc").alias("id")).agg(F.collect_list(F.struct(F.col("id").alias("chunk_id"), "content_hash")).alias("_texts"))
        return by_source.join(by_doc, "id", "full")

    def cursors(self) -> DataFrame:
        """(source, cursor): the newest time each source has been loaded up to."""
        return self.spark.read.parquet(f"{self.base}/cursors").groupBy("source").agg(F.max("cursor").alias("cursor"))

    def index(self, batch: int = 1 << 30, prune: bool = False) -> DataFrame | None:
        """Latest text and latest metadata of every row.

        ``prune`` leaves out chunks that the last load of their document did
        not write any more.
        """
        rows = self._rows(batch, prune)
        return None if rows is None else _with_indexed(rows)

    def _rows(self, batch: int = 1 << 30, prune: bool = False) -> DataFrame | None:
        rows = self.stored.read("index", batch)
        if rows is None:
            return None
        if prune:
            last = _latest_rows(rows.withColumn("_doc", F.coalesce("parent_doc_id", "id")), "_doc")
            newest = F.max("batch").over(Window.partitionBy("_doc"))
            last = last.withColumn("_newest", newest).filter(F.col("batch") == F.col("_newest")).drop("_newest", "_doc")
        else:
            last = _latest_rows(rows)
        return last.drop("batch", "route")

    def _load(self, page: DataFrame, batch: int) -> None:
        stored = self.stored
        if stored.done(batch):
            return
        repeated = not page.groupBy("id").count().filter("count > 1").isEmpty()
        docs = self.score(latest(page, "seq") if repeated else page).withColumn("doc_hash", doc_hash(*[F.col(c) for c in self.hash_of]))
        known = self._known(batch, page)
        todo = docs
        if known is not None:
            old = F.get(F.filter("_hashes", lambda x: x["source"] == F.col("source")), F.lit(0))["hash"]
            todo = docs.join(known, "id", "left").filter(~F.col("doc_hash").eqNullSafe(old)).drop("_hashes")
        if known is not None or repeated or self.score is not _as_is:
            # Written once: the index and the hashes are both made from it.
            todo = materialize(todo, "todo")
        rows = explode_chunks(todo, spread=False)
        rows = rows.withColumn("_header", header_of(rows)).withColumn("content_hash", content_hash(F.col("chunk"))).drop("content")
        route = F.lit("full")
        if known is not None:
            text = F.get(F.filter("_texts", lambda x: x["chunk_id"] == F.col("id")), F.lit(0))["content_hash"]
            route = F.when((F.col("content_hash") == text) & (text != ""), "meta").otherwise("full")
        routed = rows.withColumn("route", route).drop("_texts")
        light = [F.when(F.col("route") == "full", F.col(c)).alias(c) if c in TEXT_COLS else F.col(c) for c in routed.columns]
        if self.cursor in page.columns:
            newest = page.groupBy("source").agg(F.max(self.cursor).alias("cursor"))
            newest.write.mode("overwrite").parquet(f"{self.base}/cursors/batch={batch}")
        stored.add(batch, {"hashes": todo.select("source", "id", F.col("doc_hash").alias("hash")), "index": routed.select(*light)})

    def run(self, files_per_batch: int | None = None) -> None:
        """Load all that has landed since the last run, then stop."""
        reader = self.spark.readStream.schema(self.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        stream = (
            reader.parquet(f"{self.base}/landing")
            .writeStream.foreachBatch(self._load)
            .option("checkpointLocation", f"{self.base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()

    def compact(self, prune: bool = False) -> DataFrame:
        """The merged index, written as one table."""
        path = fresh_path(self.spark, "index")
        self._rows(prune=prune).write.partitionBy("source").parquet(path)
        return _with_indexed(self.spark.read.parquet(path))


def new_job(spark: SparkSession, hash_of: list[str], base: str | None = None, **options) -> IncrementalJob:
    return IncrementalJob(spark, base or fresh_path(spark, "load"), hash_of, **options)

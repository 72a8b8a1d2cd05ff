"""Streaming twins of the status, daily counter and de-duplication jobs.

Sinks are files in the shared folder; nothing is gathered in the driver, and a
query that starts again goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

def status_stream(events: DataFrame, path: str) -> StreamingQuery:
    """Latest state per source; each batch appends the sources that moved."""
    state = events.groupBy("source").agg(
        F.max_by(F.struct("status", "docs", "started_at", "run_id"), "seq").alias("s"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n_runs")
    ).select("source", "s.*", "seq", "n_runs")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/states/batch={number}")

    return (
        state.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )


def status_now(spark: SparkSession, path: str) -> DataFrame:
    """The state the feed shows: the newest row of each source."""
    rows = spark.read.parquet(f"{path}/states")
    cols = [c for c in rows.columns if c not in ("source", "batch")]
    return rows.groupBy("source").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("source", "s.*")


def daily_stream(events: DataFrame, path: str) -> StreamingQuery:
    """Runs, documents and errors by source and day; each batch writes the days it changed.

    No run is late: open days are written as they are, and again when they grow.
    """
    days = events.groupBy("source", F.date_trunc("day", "completed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("docs").alias("docs"), F.count_if(F.col("status") == "error").alias("errors")
    )

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/days/batch={number}")

    return (
        days.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )


def daily_now(spark: SparkSession, path: str) -> DataFrame:
    """The counters so far: the newest row of each source and day."""
    rows = spark.read.parquet(f"{path}/days")
    newest = rows.groupBy("source", "day").agg(F.max_by(F.struct("runs", "docs", "errors"), "batch").alias("s"))
    return newest.select("source", "day", "s.*")


def dedupe_stream(docs: DataFrame, path: str, at: str = "seen_at") -> StreamingQuery:
    """Documents sent again with the text they had last are dropped.

    As in the batch job a document is compared with its latest hash, so a text
    that goes back to an earlier form is a change.  Each batch keeps the last
    hash of its documents beside the rows; a repeated batch writes the same.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = f"{path}/hashes"
        order = Window.partitionBy("id").orderBy(at, "doc_hash")
        rows = batch.withColumn("_before", F.lag("doc_hash").over(order)).withColumn("_first", F.row_number().over(order) == 1)
        if number:
            earlier = spark.read.schema("id string, doc_hash string, batch long").parquet(kept).filter(F.col("batch") < number)
            last = earlier.groupBy("id").agg(F.max_by("doc_hash", "batch").alias("_last"))
            rows = rows.join(last, "id", "left").withColumn("_before", F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_before"))).drop("_last")
        changed = rows.filter(~F.col("doc_hash").eqNullSafe(F.col("_before"))).drop("_before", "_first")
        changed.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        newest = batch.groupBy("id").agg(F.max_by("doc_hash", F.struct(at, "doc_hash")).alias("doc_hash"))
        newest.write.mode("overwrite").parquet(f"{kept}/batch={number}")

    return (
        docs.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )


def land(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(f"{path}/landing")


def landed(spark: SparkSession, df: DataFrame, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(df.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}/landing")

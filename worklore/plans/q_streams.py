"""Queries A15 to A17: streams, drained and read back."""

from pyspark.sql import functions as F

from worklore.plans.q_runs import c
from worklore.plans.q_upsert import HASH_SQL, hashed, old_docs
from worklore.plans.registry import query
from worklore.plans.standins import standin
from worklore.session import fresh_path
from worklore.streaming import feeds as S


@query(
    "a15_status_stream",
    """SELECT source, arg_max(status, seq) AS status, arg_max(docs, seq) AS docs, arg_max(run_id, seq) AS run_id, count(*) AS n_runs FROM v_runs GROUP BY source""",
)
def a15(spark, sf):
    path = fresh_path(spark, "status")
    runs = standin(spark, sf, "v_runs")
    for half in (c("seq") % 2 == 0, c("seq") % 2 == 1):
        S.land(runs.filter(half), path)
        S.status_stream(S.landed(spark, runs, path), path).awaitTermination()
    return S.status_now(spark, path).select("source", "status", "docs", "run_id", "n_runs")


@query(
    "a16_daily_stream",
    """SELECT source, strftime(date_trunc('day', completed_at), '%Y-%m-%d') AS day, count(*) AS runs, CAST(sum(docs) AS BIGINT) AS docs, count(*) FILTER (status = 'error') AS errors
       FROM v_run_ends GROUP BY ALL""",
)
def a16(spark, sf):
    path = fresh_path(spark, "daily")
    runs = standin(spark, sf, "v_run_ends").withColumn("completed_at", c("completed_at").cast("timestamp"))
    for half in (c("seq") % 2 == 0, c("seq") % 2 == 1):
        S.land(runs.filter(half), path)
        S.daily_stream(S.landed(spark, runs, path), path).awaitTermination()
    return S.daily_now(spark, path).select("source", F.date_format("day", "yyyy-MM-dd").alias("day"), "runs", "docs", "errors")


@query(
    "a17_dedupe_stream",
    f"""WITH h AS (SELECT 1 AS round, id, {HASH_SQL} AS doc_hash FROM c_old UNION ALL SELECT 2, id, {HASH_SQL} FROM v_docs
                   UNION ALL SELECT 3, id, {HASH_SQL} FROM v_docs UNION ALL SELECT 4, id, {HASH_SQL} FROM c_old)
        SELECT round, id, doc_hash FROM (SELECT *, lag(doc_hash) OVER (PARTITION BY id ORDER BY round) AS before FROM h) WHERE before IS DISTINCT FROM doc_hash""",
)
def a17(spark, sf):
    path = fresh_path(spark, "dedupe")
    """Old texts, new ones, the same again, and back to the old ones."""
    old, new = old_docs(spark, sf), standin(spark, sf, "v_docs")
    for number, page in enumerate([old, new, new, old], 1):
        rows = hashed(page).select("id", "doc_hash", F.lit(number).alias("round"), F.coalesce("updated_at", "other_at", "created_at").cast("timestamp").alias("seen_at"))
        S.land(rows, path)
        S.dedupe_stream(S.landed(spark, rows, path), path).awaitTermination()
    return spark.read.parquet(f"{path}/docs").select("round", "id", "doc_hash")



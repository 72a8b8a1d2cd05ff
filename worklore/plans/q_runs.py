"""Queries A01 to A14: run analytics and status."""

from pyspark.sql import functions as F

from worklore.functions.text import epoch_ms
from worklore.operators import runs as A
from worklore.plans.q_sources import c
from worklore.plans.registry import query
from worklore.plans.standins import CHECK_VIEWS, DOCS_AS_OF, VIEWS, standin

VIEWS["v_run_ends"] = """
  SELECT seq, run_id, source, started_at, started_ms,
         started_at + INTERVAL '1' MINUTE * CAST(1 + duration_ms % 50 AS INT) AS completed_at, duration_ms, status, docs
  FROM v_runs WHERE status <> 'running'"""
# the log as it is stored: the start row of every second run was not replaced
VIEWS["v_run_log"] = """
  SELECT seq * 2 + 1 AS seq, run_id, source, started_at, completed_at, duration_ms, status, docs FROM v_run_ends
  UNION ALL
  SELECT seq * 2, run_id || '_open', source, started_at, CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), 'running', CAST(0 AS BIGINT)
  FROM v_runs WHERE seq % 2 = 0 OR status = 'running'"""
VIEWS["v_jobs"] = """
  SELECT 'job_' || CAST(seq AS STRING) AS job_id, source, started_at,
         CASE seq % 8 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'TIMED_OUT'
              WHEN 4 THEN 'CANCELLED' WHEN 5 THEN 'TERMINATED' WHEN 6 THEN 'CONTINUED_AS_NEW' ELSE 'COMPLETED' END AS state,
         CASE WHEN seq % 8 NOT IN (0, 6) THEN started_at + INTERVAL '1' MINUTE * CAST(1 + seq % 90 AS INT) END AS closed_at
  FROM v_runs"""


def ms(name):
    return epoch_ms(c(name))


def log(spark, sf):
    return standin(spark, sf, "v_run_log")


def all_sources(spark, sf):
    """The six tags, as the document table has them."""
    return standin(spark, sf, "v_docs").select("source").distinct()


@query(
    "a01_run_log",
    """SELECT s.run_id, s.source, coalesce(e.status, 'running') AS status, coalesce(e.docs, 0) AS docs, epoch_ms(e.completed_at) AS completed_ms
       FROM v_runs s LEFT JOIN v_run_ends e ON s.run_id = e.run_id""",
)
def a01(spark, sf):
    ends = standin(spark, sf, "v_run_ends")
    starts = standin(spark, sf, "v_runs").filter(c("docs") % 10 != 3).select(
        "seq", "run_id", "source", "started_at", "started_ms", F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit(None).cast("long").alias("duration_ms"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("docs"),
    )
    more = standin(spark, sf, "v_runs").filter((c("docs") % 10 == 3) & (c("status") == "running"))
    starts = starts.unionByName(more.select("seq", "run_id", "source", "started_at", "started_ms", F.lit(None).cast("timestamp").alias("completed_at"),
                                            F.lit(None).cast("long").alias("duration_ms"), "status", F.lit(0).cast("long").alias("docs")))
    return A.run_log(starts, ends).select("run_id", "source", "status", "docs", ms("completed_at").alias("completed_ms"))


@query("a02_trim", "SELECT source, run_id FROM v_run_log QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) <= 100")
def a02(spark, sf):
    return A.trim_runs(log(spark, sf)).select("source", "run_id")


CHECK_VIEWS["c_stats"] = """
  SELECT s.source, count(e.run_id) AS total_runs, count(e.run_id) FILTER (e.status = 'completed') AS ok_runs, count(e.run_id) FILTER (e.status = 'error') AS failed_runs,
         max(epoch_ms(e.completed_at)) AS last_run_ms, max(epoch_ms(e.completed_at)) FILTER (e.status = 'completed') AS last_ok_ms,
         CAST(coalesce(sum(e.docs), 0) AS BIGINT) AS docs, round(avg(CASE WHEN e.duration_ms > 0 THEN e.duration_ms END), 6) AS plain_mean_ms
  FROM (SELECT DISTINCT source FROM v_docs) s LEFT JOIN v_run_ends e ON s.source = e.source GROUP BY s.source"""


@query("a03_source_stats", "SELECT * FROM c_stats")
def a03(spark, sf):
    st = A.source_stats(standin(spark, sf, "v_run_ends"), all_sources(spark, sf))
    return st.select(
        "source", "total_runs", "ok_runs", "failed_runs", ms("last_run_at").alias("last_run_ms"), ms("last_ok_at").alias("last_ok_ms"), "docs",
        F.round("plain_mean_ms", 6).alias("plain_mean_ms"),
    )


@query(
    "a04_mean_duration",
    """WITH RECURSIVE o AS MATERIALIZED (SELECT source, duration_ms AS d, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM v_run_ends),
       f AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS m FROM (SELECT DISTINCT source FROM o)
             UNION ALL SELECT f.source, o.n, CASE WHEN o.d = 0 THEN f.m ELSE CAST(floor((f.m * (o.n - 1) + o.d) / CAST(o.n AS DOUBLE) + 0.5) AS BIGINT) END
             FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1)
       SELECT source, m AS mean_ms FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC) = 1""",
)
def a04(spark, sf):
    return A.mean_duration(standin(spark, sf, "v_run_ends"))


CHECK_VIEWS["c_recent"] = """+
  c_fetch AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS pos FROM v_run_log QUALIFY pos <= 40),
  c_one AS (SELECT *, min(pos) OVER (PARTITION BY source, started_at) AS first_pos FROM c_fetch
            QUALIFY row_number() OVER (PARTITION BY source, started_at ORDER BY status = 'running', pos) = 1),
  c_recent AS (SELECT source, run_id, status, started_at, seq, CAST(row_number() OVER (PARTITION BY source ORDER BY first_pos) AS INT) AS place FROM c_one QUALIFY place <= 20)"""


@query("a05_recent_runs", "SELECT source, run_id, status, place FROM c_recent")
def a05(spark, sf):
    return A.recent_runs(log(spark, sf)).select("source", "run_id", "status", "place")


@query("a06_all_recent", "SELECT source, run_id, status FROM c_recent ORDER BY started_at DESC, seq DESC LIMIT 20")
def a06(spark, sf):
    return A.all_recent(log(spark, sf)).select("source", "run_id", "status")


@query("a07_system_stats", "SELECT CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(total_runs) AS BIGINT) AS runs, count(*) AS sources FROM c_stats")
def a07(spark, sf):
    return A.system_stats(A.source_stats(standin(spark, sf, "v_run_ends"), all_sources(spark, sf)))


@query(
    "a08_daily",
    """WITH d AS (SELECT source, CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT source FROM v_docs))
       SELECT d.source, strftime(d.day, '%Y-%m-%d') AS day, count(e.run_id) AS runs, CAST(coalesce(sum(e.docs), 0) AS BIGINT) AS docs, count(e.run_id) FILTER (e.status = 'error') AS errors
       FROM d LEFT JOIN v_run_ends e ON e.source = d.source AND CAST(e.completed_at AS DATE) = d.day GROUP BY ALL""",
)
def a08(spark, sf):
    d = A.daily_stats(standin(spark, sf, "v_run_ends"), all_sources(spark, sf), 35, DOCS_AS_OF)
    return d.select("source", F.date_format("day", "yyyy-MM-dd").alias("day"), "runs", "docs", "errors")


def status_table(spark, sf):
    """The last row of each source, as the status store keeps it."""
    last = standin(spark, sf, "v_runs").groupBy("source").agg(
        F.max_by(F.struct("status", "docs", "started_at", "seq"), "seq").alias("l"), F.sum("docs").alias("docs")
    )
    return last.select(
        "source", c("l.status").alias("status"), "docs", c("l.started_at").alias("last_sync"),
        (c("l.started_at") - F.expr("INTERVAL '1' HOUR") * (c("l.seq") % 30).cast("int")).alias("set_at"),
        F.when(c("l.status") == "error", F.concat(F.lit("failed "), c("l.seq"))).alias("error"),
        (c("l.seq") % 4 == 0).alias("disabled"),
    )


CHECK_VIEWS["c_status"] = """
  SELECT source, status, total AS docs, started_at AS last_sync, started_at - INTERVAL '1' HOUR * CAST(seq % 30 AS INT) AS set_at,
         CASE WHEN status = 'error' THEN 'failed ' || seq END AS error, seq % 4 = 0 AS disabled
  FROM (SELECT *, CAST(sum(docs) OVER (PARTITION BY source) AS BIGINT) AS total FROM v_runs)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) = 1"""
CHECK_VIEWS["c_last_jobs"] = "SELECT * FROM v_jobs QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC) = 1"


@query(
    "a09_dashboard",
    """SELECT CAST(sum(docs) AS BIGINT) AS docs, count(*) FILTER (docs > 0) AS active, count(*) FILTER (status IN ('error', 'failed')) AS failing, epoch_ms(max(last_sync)) AS last_ms
       FROM c_status WHERE NOT disabled""",
)
def a09(spark, sf):
    return A.dashboard(status_table(spark, sf)).select("docs", "active", "failing", ms("last_sync").alias("last_ms"))


@query(
    "a10_source_info",
    """SELECT d.source, CASE j.state WHEN 'RUNNING' THEN 'running' WHEN 'CONTINUED_AS_NEW' THEN 'running' WHEN 'COMPLETED' THEN 'completed' WHEN 'FAILED' THEN 'failed'
              WHEN 'TIMED_OUT' THEN 'failed' WHEN 'CANCELLED' THEN 'cancelled' WHEN 'TERMINATED' THEN 'cancelled' ELSE 'idle' END AS status,
              coalesce(s.docs, 0) AS docs, epoch_ms(CASE WHEN j.state = 'COMPLETED' THEN j.closed_at ELSE s.last_sync END) AS last_ms,
              CASE WHEN j.job_id IS NOT NULL THEN s.error END AS error, j.job_id, d.source IN ('drive', 'calendar') AS disabled
       FROM (SELECT DISTINCT source FROM v_docs) d LEFT JOIN c_last_jobs j ON d.source = j.source LEFT JOIN c_status s ON d.source = s.source""",
)
def a10(spark, sf):
    off = all_sources(spark, sf).filter(c("source").isin("drive", "calendar"))
    info = A.source_info(all_sources(spark, sf), standin(spark, sf, "v_jobs"), status_table(spark, sf), off)
    return info.select("source", "status", "docs", ms("last_sync").alias("last_ms"), "error", "job_id", "disabled")


@query(
    "a11_reset_stale",
    """SELECT r.source, r.run_id, CASE WHEN r.status = 'running' AND r.source NOT IN (SELECT source FROM v_jobs WHERE state = 'RUNNING' AND source <> 'gmail') THEN 'idle' ELSE r.status END AS status FROM v_runs r""",
)
def a11(spark, sf):
    jobs = standin(spark, sf, "v_jobs").filter(c("source") != "gmail")
    return A.reset_stale(standin(spark, sf, "v_runs"), jobs).select("source", "run_id", "status")


@query(
    "a12_all_status",
    """SELECT d.source, coalesce(s.status, 'idle') AS status, coalesce(s.docs, 0) AS docs FROM (SELECT DISTINCT source FROM v_docs) d
       LEFT JOIN (SELECT * FROM c_status WHERE set_at > TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 24 HOUR) s ON d.source = s.source""",
)
def a12(spark, sf):
    return A.all_status(status_table(spark, sf), all_sources(spark, sf), "2024-01-31 12:00:00").select("source", "status", "docs")


@query(
    "a13_recent_jobs",
    "SELECT job_id, state, epoch_ms(closed_at) - epoch_ms(started_at) AS took_ms FROM v_jobs ORDER BY started_at DESC, job_id LIMIT 20",
)
def a13(spark, sf):
    return A.recent_jobs(standin(spark, sf, "v_jobs")).select("job_id", "state", "took_ms")


@query("a14_stale_sync", "SELECT source, last_sync < TIMESTAMP '2024-01-31 23:58:00' - INTERVAL 24 HOUR AS stale FROM c_status")
def a14(spark, sf):
    return A.stale_sync(status_table(spark, sf), "2024-01-31 23:58:00").select("source", "stale")

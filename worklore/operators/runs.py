"""Run log, statistics and source status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklore.operators.spread import numbered

# Fixed values.
KEEP_RUNS = 100
KEEP_DAYS = 90
RECENT = 20
STATUS_HOURS = 24
JOB_STATES = {
    "RUNNING": "running", "CONTINUED_AS_NEW": "running", "COMPLETED": "completed", "FAILED": "failed",
    "TIMED_OUT": "failed", "CANCELLED": "cancelled", "TERMINATED": "cancelled",
}


def run_log(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """A finished run takes the place of its start row; one without is added."""
    cols = [c for c in ends.columns if c != "run_id"]
    old = starts.select("run_id", *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_open"))
    both = old.join(ends.withColumn("_done", F.lit(True)), "run_id", "full_outer")
    return both.select("run_id", *[F.when(F.col("_done"), F.col(c)).otherwise(F.col(f"_s_{c}")).alias(c) for c in cols])


def trim_runs(log: DataFrame, n: int = KEEP_RUNS) -> DataFrame:
    """The newest ``n`` runs of each source; each task keeps only its own newest."""
    w = Window.partitionBy("source").orderBy(F.desc("seq"))
    return log.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def source_stats(log: DataFrame, sources: DataFrame) -> DataFrame:
    """Totals per source over its finished runs; zeros for one that never ran."""
    done = F.coalesce("completed_at", "started_at")
    ok = F.col("status") == "completed"
    per = log.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(ok).alias("ok_runs"),
        F.count_if(F.col("status") == "error").alias("failed_runs"),
        F.max(done).alias("last_run_at"),
        F.max(F.when(ok, done)).alias("last_ok_at"),
        F.sum("docs").alias("docs"),
        F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))).alias("plain_mean_ms"),
    )
    return sources.select("source").join(per, "source", "left").na.fill(0, ["total_runs", "ok_runs", "failed_runs", "docs"])


def _fold_means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    source, mean = None, 0
    for batch in batches:
        for s, n, d in zip(batch["source"], batch["n"], batch["duration_ms"]):
            if s != source:
                if source is not None:
                    yield pd.DataFrame({"source": [source], "mean_ms": [mean]})
                source, mean = s, 0
            # half goes up, in whole numbers
            mean = (2 * (mean * (n - 1) + d) + n) // (2 * n)
    if source is not None:
        yield pd.DataFrame({"source": [source], "mean_ms": [mean]})


def mean_duration(log: DataFrame) -> DataFrame:
    """Running mean, rounded at every run; runs of 0 ms count but do not weigh.

    Step n moves the mean by round((d - mean) / n), which is 0 once n is over
    twice the largest possible |d - mean|.  So a run can only matter if
    2 * max(d, largest - d) >= n: what is folded in order is bounded by the
    longest duration and not by the number of runs.
    """
    ranked = numbered(log, ["source"], [F.col("started_at"), F.col("seq")], "n")
    longest = log.groupBy("source").agg(F.max("duration_ms").alias("_max"))
    moving = ranked.join(longest, "source").filter(
        (F.col("duration_ms") > 0)
        & (2 * F.greatest("duration_ms", F.col("_max") - F.col("duration_ms")) >= F.col("n"))
    )
    ordered = moving.select("source", "n", "duration_ms").repartition("source").sortWithinPartitions("source", "n")
    means = ordered.mapInPandas(_fold_means, "source string, mean_ms long")
    return log.select("source").distinct().join(means, "source", "left").na.fill(0, ["mean_ms"])


def recent_runs(log: DataFrame, n: int = RECENT) -> DataFrame:
    """Newest runs per source, one per start time, a finished row before a running one."""
    newest = Window.partitionBy("source").orderBy(F.desc("seq"))
    fetched = log.withColumn("_pos", F.row_number().over(newest)).filter(F.col("_pos") <= 2 * n)
    same = Window.partitionBy("source", "started_at")
    best = same.orderBy((F.col("status") == "running").cast("int"), "_pos")
    one = fetched.withColumn("_first", F.min("_pos").over(same)).withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") == 1)
    place = Window.partitionBy("source").orderBy("_first")
    return one.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n).drop("_pos", "_first", "_rn")


def all_recent(log: DataFrame, n: int = RECENT) -> DataFrame:
    return recent_runs(log, n).orderBy(F.desc("started_at"), F.desc("seq")).limit(n)


def system_stats(stats: DataFrame) -> DataFrame:
    """Sums over the sources."""
    return stats.agg(F.sum("docs").alias("docs"), F.sum("total_runs").alias("runs"), F.count(F.lit(1)).alias("sources"))


def daily_stats(log: DataFrame, sources: DataFrame, days: int, as_of: str) -> DataFrame:
    """Runs, documents and errors by source and day; the last ``days`` with zeros."""
    end = F.to_date(F.lit(as_of))
    keep = min(days, KEEP_DAYS)
    first = F.date_sub(end, keep - 1)
    day = F.to_date(F.coalesce("completed_at", "started_at"))
    per = log.filter((day >= first) & (day <= end)).groupBy("source", day.alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("docs").alias("docs"), F.count_if(F.col("status") == "error").alias("errors")
    )
    spine = sources.select("source", F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    return spine.join(per, ["source", "day"], "left").na.fill(0, ["runs", "docs", "errors"])


def dashboard(status: DataFrame) -> DataFrame:
    """Totals of the sources that are not switched off."""
    on = status.filter(~F.col("disabled"))
    return on.agg(
        F.sum("docs").alias("docs"), F.count_if(F.col("docs") > 0).alias("active"),
        F.count_if(F.col("status").isin("error", "failed")).alias("failing"), F.max("last_sync").alias("last_sync"),
    )


def last_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of each source."""
    cols = [c for c in jobs.columns if c != "source"]
    return jobs.groupBy("source").agg(F.max_by(F.struct(*cols), "started_at").alias("_j")).select("source", "_j.*")


def source_info(sources: DataFrame, jobs: DataFrame, status: DataFrame, disabled: DataFrame) -> DataFrame:
    """Job state in our words, with the stored status and the off switch."""
    pairs = [F.lit(x) for kv in JOB_STATES.items() for x in kv]
    j = last_jobs(jobs).select("source", F.col("state").alias("_state"), "closed_at", "job_id", F.lit(True).alias("_job"))
    s = status.select("source", "docs", F.col("last_sync").alias("_sync"), F.col("error").alias("_error"))
    off = disabled.select("source", F.lit(True).alias("disabled")).distinct()
    rows = sources.select("source").join(j, "source", "left").join(s, "source", "left").join(off, "source", "left")
    return rows.select(
        "source",
        F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("_state", F.lit(""))), F.lit("idle")).alias("status"),
        F.coalesce("docs", F.lit(0)).alias("docs"),
        F.when(F.col("_state") == "COMPLETED", F.col("closed_at")).otherwise(F.col("_sync")).alias("last_sync"),
        F.when(F.col("_job"), F.col("_error")).alias("error"),
        "job_id",
        F.coalesce("disabled", F.lit(False)).alias("disabled"),
    )


def reset_stale(status: DataFrame, jobs: DataFrame) -> DataFrame:
    """A source that says running but has no live job is idle."""
    live = jobs.filter(F.col("state") == "RUNNING").select("source", F.lit(True).alias("_live")).distinct()
    stuck = (F.col("status") == "running") & F.col("_live").isNull()
    return status.join(live, "source", "left").withColumn("status", F.when(stuck, "idle").otherwise(F.col("status"))).drop("_live")


def all_status(status: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Status of every source; rows older than a day do not count any more."""
    live = status.filter(F.col("set_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{STATUS_HOURS}' HOUR"))
    rows = sources.select("source").join(live, "source", "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("idle"))).withColumn("docs", F.coalesce("docs", F.lit(0)))


def recent_jobs(jobs: DataFrame, n: int = RECENT) -> DataFrame:
    took = F.unix_millis(F.col("closed_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return jobs.withColumn("took_ms", took).orderBy(F.desc("started_at"), "job_id").limit(n)


def stale_sync(status: DataFrame, as_of: str) -> DataFrame:
    limit = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL '24' HOUR")
    return status.withColumn("stale", F.coalesce(F.col("last_sync") < limit, F.lit(True)))

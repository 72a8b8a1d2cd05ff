"""Relevance features for the document table, all sources in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklore.functions import relevance as V
from worklore.functions.relevance import Identity
from worklore.operators.joins import left_join_where

NEEDED = {
    "sender": "string", "recipients": "array<string>", "cc": "array<string>", "thread_id": "string",
    "thread_message_count": "long", "channel": "string", "channel_type": "string", "mentioned_users": "array<string>",
    "thread_ts": "string", "priority": "string", "assignee": "string", "owner": "string", "labels": "array<string>",
    "ancestors": "array<string>", "attendees": "array<string>", "organizer": "string", "start": "timestamp",
    "updated_at": "timestamp", "modified_at": "timestamp",
}


def _len(name: str):
    return F.greatest(F.lit(0), F.coalesce(F.size(name), F.lit(0)))


def thread_depth(df: DataFrame) -> DataFrame:
    """Given count, else the number of rows of the thread; null with no thread."""
    mail = (F.col("source") == "gmail") & (F.coalesce("thread_id", F.lit("")) != "")
    counts = df.filter(mail).groupBy("thread_id").agg(F.count(F.lit(1)).alias("_in_thread"))
    depth = F.when(F.col("source") == "gmail", F.coalesce("thread_message_count", "_in_thread"))
    return left_join_where(df, counts, "thread_id", mail).withColumn("thread_depth", depth).drop("_in_thread")


def email_features(df: DataFrame, who: Identity = Identity()) -> DataFrame:
    df = thread_depth(df)
    df = df.withColumn("recipient_count", _len("recipients") + _len("cc")).withColumn(
        "is_internal", V.is_internal(F.col("sender"), who.company_domains)
    )
    return df


def chat_features(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("channel_type", V.channel_type(F.col("channel_type"), F.coalesce("channel", F.lit(""))))
        .withColumn("mention_count", _len("mentioned_users"))
        .withColumn("is_thread_participant", F.coalesce("thread_ts", F.lit("")) != "")
    )


def add_relevance(docs: DataFrame, who: Identity, as_of: str) -> DataFrame:
    """Features and ``relevance_score`` of every document by its source."""
    now = F.lit(as_of).cast("timestamp")
    for name, kind in NEEDED.items():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    df = thread_depth(docs)
    src = F.col("source")

    def only(tag, value):
        return F.when(src == tag, value)

    updated, modified = V.days_since(F.col("updated_at"), now), V.days_since(F.col("modified_at"), now)
    df = df.select(
        *[c for c in df.columns if c != "channel_type"],
        only("gmail", _len("recipients") + _len("cc")).alias("recipient_count"),
        only("gmail", V.is_internal(F.col("sender"), who.company_domains)).alias("is_internal"),
        only("slack", V.channel_type(F.col("channel_type"), F.coalesce("channel", F.lit("")))).alias("channel_type"),
        only("slack", _len("mentioned_users")).alias("mention_count"),
        only("slack", F.coalesce("thread_ts", F.lit("")) != "").alias("is_thread_participant"),
        only("jira", V.priority_weight(F.coalesce("priority", F.lit("None")))).alias("priority_weight"),
        only("jira", updated).alias("days_since_update"),
        only("jira", V.is_me(src, F.col("assignee"), who)).alias("is_assigned_to_me"),
        only("drive", modified).alias("days_since_modified"),
        only("drive", V.is_me(src, F.col("owner"), who)).alias("is_owner"),
        only("confluence", _len("labels")).alias("label_count"),
        only("confluence", _len("ancestors")).alias("hierarchy_depth"),
        only("calendar", _len("attendees")).alias("attendee_count"),
        only("calendar", V.is_me(src, F.col("organizer"), who)).alias("is_organizer"),
        only("calendar", F.lit(False)).alias("is_recurring"),
    )
    c = F.col
    score = (
        F.when(src == "gmail", V.email_score(c("is_internal"), c("recipient_count"), c("thread_depth")))
        .when(src == "slack", V.chat_score(c("channel_type"), c("mention_count"), c("is_thread_participant")))
        .when(src == "jira", V.issue_score(c("is_assigned_to_me"), c("priority_weight"), c("days_since_update")))
        .when(src == "drive", V.file_score(c("is_owner"), c("days_since_modified")))
        .when(src == "confluence", V.page_score(c("label_count"), c("hierarchy_depth"), updated))
        .when(src == "calendar", V.meeting_score(c("is_organizer"), c("attendee_count"), c("start"), now))
    )
    return df.withColumn("relevance_score", score)



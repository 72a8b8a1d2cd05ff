"""Queries F01 to F13: relevance features."""

from pyspark.sql import functions as F

from worklore.functions import relevance as V
from worklore.operators import features as X
from worklore.plans import raw as R
from worklore.plans.q_sources import c  # noqa: F401  (also loads the check views)
from worklore.plans.registry import query
from worklore.plans.standins import CHECK_VIEWS, DOCS_AS_OF, ORDERS_AS_OF, standin
from worklore.sources import chat, mail
from worklore.sources.documents import all_docs

WHO = X.Identity(tracker_mail="Customer#000000007", office_mail="user7@corp.example", company_domains=("corp.example", " Partner.io "))


def now():
    return F.lit(DOCS_AS_OF).cast("timestamp")


def r6(x):
    return F.round(x, 6)




def email_rows(spark, sf):
    d = mail.emails(R.raw_mail(spark, sf))
    return d.withColumn("thread_message_count", F.when(c("subject").startswith("Urgent"), F.lit(5)).cast("long"))


CHECK_VIEWS["c_mail_features"] = """
  SELECT 'gmail_' || message_id AS id, len(rcpt) + len(ccs) AS recipient_count,
         CASE WHEN subject LIKE 'Urgent%' THEN 5 ELSE count(*) OVER (PARTITION BY thread_id) END AS thread_depth,
         lower(split_part(sender, '@', 2)) IN ('corp.example', 'partner.io') AS is_internal
  FROM c_mail"""


@query("f01_email_features", "SELECT id, CAST(recipient_count AS INT) AS recipient_count, CAST(thread_depth AS BIGINT) AS thread_depth, is_internal FROM c_mail_features")
def f01(spark, sf):
    return X.email_features(email_rows(spark, sf), WHO).select("id", "recipient_count", "thread_depth", "is_internal")


@query(
    "f02_internal",
    """SELECT message_id AS id, lower(split_part(sender, '@', 2)) IN ('corp.example', 'partner.io') AS by_list,
              split_part(sender, '@', 2) <> '' AND lower(split_part(sender, '@', 2)) NOT IN ('gmail.com', 'yahoo.com', 'hotmail.com', 'outlook.com', 'aol.com') AS by_default FROM v_mail""",
)
def f02(spark, sf):
    v = standin(spark, sf, "v_mail")
    return v.select(
        c("message_id").alias("id"), V.is_internal(c("sender"), WHO.company_domains).alias("by_list"), V.is_internal(c("sender")).alias("by_default")
    )


@query(
    "f03_email_score",
    """SELECT id, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN is_internal THEN 0.2 ELSE 0 END + CASE WHEN recipient_count <= 3 THEN 0.15 ELSE 0 END
              + CASE WHEN thread_depth > 1 THEN 0.1 ELSE 0 END), 6) AS score FROM c_mail_features""",
)
def f03(spark, sf):
    d = X.email_features(email_rows(spark, sf), WHO)
    return d.select("id", r6(V.email_score(c("is_internal"), c("recipient_count"), c("thread_depth"))).alias("score"))


def chat_rows(spark, sf):
    d = chat.messages(R.raw_messages(spark, sf), R.chat_users(spark, sf), R.chat_channels(spark, sf))
    kind = F.when(c("channel_id") == "C1", "mpim").when(c("channel_id") == "C2", "private").when(c("channel_id") == "C5", "dm").otherwise("")
    return X.chat_features(d.withColumn("channel_type", kind))


CHECK_VIEWS["c_chat_features"] = """
  SELECT 'slack_' || channel_id || '_' || ts AS id,
         CASE channel_id WHEN 'C1' THEN 'mpim' WHEN 'C2' THEN 'private' WHEN 'C5' THEN 'dm' ELSE CASE WHEN channel LIKE 'DM%' THEN 'dm' ELSE 'public' END END AS channel_type,
         CASE WHEN n1 IS NULL THEN 0 ELSE 2 END AS mention_count, thread_ts IS NOT NULL AS in_thread FROM c_msg"""


@query("f04_chat_features", "SELECT id, channel_type, mention_count, in_thread FROM c_chat_features")
def f04(spark, sf):
    return chat_rows(spark, sf).select("id", "channel_type", "mention_count", c("is_thread_participant").alias("in_thread"))


@query(
    "f05_chat_score",
    """SELECT id, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE channel_type WHEN 'dm' THEN 0.3 WHEN 'private' THEN 0.15 WHEN 'mpim' THEN 0.2 ELSE 0 END
              + CASE WHEN mention_count > 0 THEN 0.1 ELSE 0 END + CASE WHEN in_thread THEN 0.05 ELSE 0 END), 6) AS score FROM c_chat_features""",
)
def f05(spark, sf):
    return chat_rows(spark, sf).select("id", r6(V.chat_score(c("channel_type"), c("mention_count"), c("is_thread_participant"))).alias("score"))


@query(
    "f06_priority_weight",
    "SELECT issue_key AS id, CASE priority WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END AS weight FROM v_issues",
)
def f06(spark, sf):
    return standin(spark, sf, "v_issues").select(c("issue_key").alias("id"), V.priority_weight(F.coalesce("priority", F.lit("None"))).alias("weight"))


CHECK_VIEWS["c_issue_days"] = f"""
  SELECT *, CAST(CASE WHEN updated IS NULL THEN 999 ELSE greatest(0, floor((epoch_ms(TIMESTAMP '{ORDERS_AS_OF}') - epoch_ms(updated)) / 86400000.0)) END AS BIGINT) AS days FROM v_issues"""


@query(
    "f07_days_since",
    f"""SELECT id, CAST(CASE WHEN updated_at IS NULL THEN 999 ELSE greatest(0, floor((epoch_ms(TIMESTAMP '{DOCS_AS_OF}') - epoch_ms(updated_at)) / 86400000.0)) END AS BIGINT) AS days FROM v_docs""",
)
def f07(spark, sf):
    return standin(spark, sf, "v_docs").select("id", V.days_since(c("updated_at"), now()).alias("days"))


@query(
    "f08_is_me",
    """SELECT issue_key AS id, coalesce(lower(assignee) = 'customer#000000007', FALSE) AS tracker, FALSE AS chat,
              coalesce(lower(assignee) = 'customer#000000007', FALSE) AS office FROM v_issues""",
)
def f08(spark, sf):
    v = standin(spark, sf, "v_issues")
    who = X.Identity(tracker_mail="CUSTOMER#000000007")
    me = lambda s: V.is_me(F.lit(s), c("assignee"), who)
    return v.select(c("issue_key").alias("id"), me("jira").alias("tracker"), me("slack").alias("chat"), me("drive").alias("office"))


@query(
    "f09_issue_score",
    """SELECT issue_key AS id, round(least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN assignee = 'Customer#000000007' THEN 0.3 ELSE 0 END
         + 0.06 * CASE priority WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END
         + CASE WHEN days < 7 THEN 0.15 WHEN days < 30 THEN 0.05 ELSE 0 END), 6) AS score FROM c_issue_days""",
)
def f09(spark, sf):
    v = standin(spark, sf, "v_issues")
    days = V.days_since(c("updated"), F.lit(ORDERS_AS_OF).cast("timestamp"))
    score = V.issue_score(V.is_me(F.lit("jira"), c("assignee"), WHO), V.priority_weight(F.coalesce("priority", F.lit("None"))), days)
    return v.select(c("issue_key").alias("id"), r6(score).alias("score"))


def days_sql(col):
    return f"(CASE WHEN {col} IS NULL THEN 999 ELSE greatest(0, floor((epoch_ms(TIMESTAMP '{DOCS_AS_OF}') - epoch_ms({col})) / 86400000.0)) END)"


@query(
    "f10_file_score",
    f"""SELECT file_id AS id, round(0.4::DOUBLE + CASE WHEN owner = 'Owner 3' THEN 0.2 ELSE 0 END
          + CASE WHEN {days_sql('modified_at')} < 7 THEN 0.2 WHEN {days_sql('modified_at')} < 30 THEN 0.1 ELSE 0 END, 6) AS score FROM v_files""",
)
def f10(spark, sf):
    who = X.Identity(tracker_mail="nobody", office_mail="owner 3")
    v = standin(spark, sf, "v_files")
    return v.select(c("file_id").alias("id"), r6(V.file_score(V.is_me(F.lit("drive"), c("owner"), who), V.days_since(c("modified_at"), now()))).alias("score"))


@query(
    "f11_page_score",
    f"""SELECT page_id, round(0.4::DOUBLE + CASE WHEN n_labels > 0 THEN 0.15 ELSE 0 END + CASE WHEN n_ancestors <= 2 THEN 0.1 ELSE 0 END
          + CASE WHEN {days_sql('coalesce(updated_at, created_at)')} < 7 THEN 0.2 WHEN {days_sql('coalesce(updated_at, created_at)')} < 30 THEN 0.1 ELSE 0 END, 6) AS score FROM v_wiki""",
)
def f11(spark, sf):
    v = standin(spark, sf, "v_wiki")
    days = V.days_since(F.coalesce("updated_at", "created_at"), now())
    return v.select("page_id", r6(V.page_score(c("n_labels"), c("n_ancestors"), days)).alias("score"))


MEETING_AS_OF = "2024-01-20 12:00:00"
HOURS = f"((epoch_ms(start_at) - epoch_ms(TIMESTAMP '{MEETING_AS_OF}')) / 3600000.0)"


@query(
    "f12_meeting_score",
    f"""SELECT meeting_id AS id, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN organizer = 'user7@corp.example' THEN 0.2 ELSE 0 END + CASE WHEN n_attendees <= 5 THEN 0.1 ELSE 0 END
          + CASE WHEN {HOURS} >= 0 AND {HOURS} <= 24 THEN 0.2 WHEN {HOURS} >= 0 AND {HOURS} <= 168 THEN 0.1 ELSE 0 END), 6) AS score FROM v_meetings""",
)
def f12(spark, sf):
    v = standin(spark, sf, "v_meetings")
    mine = V.is_me(F.lit("calendar"), c("organizer"), WHO)
    score = V.meeting_score(mine, c("n_attendees"), c("start_at"), F.lit(MEETING_AS_OF).cast("timestamp"))
    return v.select(c("meeting_id").alias("id"), r6(score).alias("score"))


def scored_docs(spark, sf, as_of=DOCS_AS_OF):
    """The document table of all sources with its features."""
    return X.add_relevance(all_docs(*R.every_source(spark, sf)), WHO, as_of)


@query(
    "f13_add_relevance",
    f"""SELECT 'gmail' AS source, id, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN is_internal THEN 0.2 ELSE 0 END + CASE WHEN recipient_count <= 3 THEN 0.15 ELSE 0 END
              + CASE WHEN n > 1 THEN 0.1 ELSE 0 END), 6) AS score
       FROM (SELECT *, count(*) OVER (PARTITION BY split_part(id, '_', 2)) AS n FROM c_mail_features)
       UNION ALL
       SELECT 'slack', id, round(0.5::DOUBLE + CASE WHEN channel LIKE 'DM%' THEN 0.3 ELSE 0 END + CASE WHEN n1 IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN thread_ts IS NOT NULL THEN 0.05 ELSE 0 END, 6)
       FROM (SELECT *, 'slack_' || channel_id || '_' || ts AS id FROM c_msg)
       UNION ALL
       SELECT 'drive', 'drive_' || file_id, round(0.4::DOUBLE + CASE WHEN {days_sql('modified_at')} < 7 THEN 0.2 WHEN {days_sql('modified_at')} < 30 THEN 0.1 ELSE 0 END, 6) FROM v_files
       UNION ALL
       SELECT 'confluence', 'confluence_' || page_id, round(0.4::DOUBLE + CASE WHEN n_labels > 0 THEN 0.15 ELSE 0 END + CASE WHEN n_ancestors <= 2 THEN 0.1 ELSE 0 END
          + CASE WHEN {days_sql('coalesce(updated_at, created_at)')} < 7 THEN 0.2 WHEN {days_sql('coalesce(updated_at, created_at)')} < 30 THEN 0.1 ELSE 0 END, 6) FROM v_wiki WHERE page_type <> 'attachment'
       UNION ALL
       SELECT 'jira', issue_key, round(0.3::DOUBLE + CASE WHEN assignee = 'Customer#000000007' THEN 0.3 ELSE 0 END
         + 0.06 * CASE priority WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END, 6) FROM v_issues""",
)
def f13(spark, sf):
    d = scored_docs(spark, sf)
    kept = d.filter((c("source") != "calendar") & ~(c("type").isin("comment")))
    return kept.select("source", "id", r6(c("relevance_score")).alias("score"))



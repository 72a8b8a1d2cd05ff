"""Work reports: deadlines, follow-ups, stale items, priorities, weekly figures.

Items are issues or tasks (id, project, status, priority, due, updated, ...),
docs the common document table.  ``as_of`` is a text time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklore.functions.relevance import days_since
from worklore.operators.spread import numbered

# Fixed values.
CLOSED = ["Done", "Closed", "Resolved"]
PRIORITY_ORDER = ["Critical", "High", "Medium", "Low"]
URGENT_WORDS = r"(?i)\b(urgent|action required|deadline|asap|please respond)\b"
DEADLINE_WORDS = r"(?i)\b(deadline|due|milestone)\b"
DEADLINE_PHRASE = (
    r"(?i)\b(?:due|deadline(?: is)?|by)\s+(?:on\s+|the\s+)?"
    r"(\d{4}-\d{2}-\d{2}|today|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday|end of (?:day|week|month))\b"
)
QUESTION = r"(?i)(\?|\bcan you\b|\bplease\b|\bthoughts on\b)"
AUTOMATED = r"(?i)(no-?reply|notification|newsletter|mailer-daemon)"
DRAFT_WORDS = r"(?i)\b(draft|wip|review)\b"
DECISION_WORDS = r"(?i)\b(decided|decision|agreed|approved|let's go with)\b"
DEEP_SOURCES = ["jira", "drive", "confluence"]
TALK_SOURCES = ["slack", "gmail"]
TOP_PER_SOURCE = 5
QUEUE = 30


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def day_of(text: str) -> Column:
    return F.to_date(F.lit(text))


def is_open(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("")).isin(CLOSED)


def priority_rank(priority: Column) -> Column:
    pairs = [x for i, p in enumerate(PRIORITY_ORDER) for x in (F.lit(p), F.lit(i))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(priority, F.lit(""))), F.lit(len(PRIORITY_ORDER)))


def between(col: Column, start: str, end: str) -> Column:
    return (col >= ts(start)) & (col < ts(end))


# -- digest --------------------------------------------------------------------


def activity_summary(docs: DataFrame, start: str, end: str) -> DataFrame:
    """Per source: rows in the range, and the best five."""
    rows = docs.filter(between(F.col("event_ts"), start, end))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("score"), "id")
    top = rows.select("source", "id", "score", F.row_number().over(w).alias("place")).filter(F.col("place") <= TOP_PER_SOURCE)
    return top.join(counts, "source")


def schedule(events: DataFrame, day: str, as_of: str) -> DataFrame:
    """Meetings of a day by start; ``soon`` if one starts within two hours."""
    rows = events.filter((F.col("start_at") >= ts(day)) & (F.col("start_at") < ts(day) + F.expr("INTERVAL '1' DAY")))
    soon = (F.col("start_at") >= ts(as_of)) & (F.col("start_at") <= ts(as_of) + F.expr("INTERVAL '2' HOUR"))
    return rows.withColumn("soon", soon).orderBy("start_at", "meeting_id")


def active_tasks(issues: DataFrame, me: str) -> DataFrame:
    mine = F.coalesce(F.col("assignee") == me, F.lit(False))
    rows = issues.filter((mine & is_open(F.col("status"))) | F.col("status").isin("In Progress", "To Do"))
    return rows.withColumn("rank", priority_rank(F.col("priority"))).orderBy("rank", F.desc("updated"), "issue_key")


def recent_messages(docs: DataFrame, since: str) -> DataFrame:
    """Direct messages and mentions, then mail to me, then copies, then the rest.

    ``docs`` has is_dm, mentions_me, to_me, cc_me.
    """
    rank = F.when(F.col("is_dm") | F.col("mentions_me"), 0).when(F.col("to_me"), 1).when(F.col("cc_me"), 2).otherwise(3)
    return docs.filter(F.col("event_ts") >= ts(since)).withColumn("rank", rank).orderBy("rank", F.desc("event_ts"), "id")


def recent_docs(docs: DataFrame, since: str, limit: int = 20) -> DataFrame:
    rows = docs.filter(F.col("is_owner") & (F.col("event_ts") >= ts(since)))
    return rows.orderBy(F.desc("event_ts"), "id").limit(limit)


def highlights(items: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """``severity`` of issues and mails; rows that are neither are left out.

    ``items`` has kind (issue, mail), status, priority, due, event_ts, text, replies.
    """
    now, c = ts(as_of), F.col
    day = F.expr("INTERVAL '24' HOUR")
    issue = (c("kind") == "issue") & is_open(c("status"))
    mail = (c("kind") == "mail") & c("text").rlike(URGENT_WORDS) & (c("replies") <= 1)
    old = c("event_ts") < now - day
    critical = (issue & (c("due") < now)) | (mail & old)
    warning = issue & (
        ((c("due") >= now) & (c("due") <= now + F.expr("INTERVAL '48' HOUR")))
        | ((c("status") == "In Review") & old)
        | (c("priority").isin("Critical", "Highest", "High") & (c("status") == "To Do"))
    )
    info = c("event_ts") >= now - F.expr(f"INTERVAL '{hours}' HOUR")
    off = lambda x: F.coalesce(x, F.lit(False))
    level = F.when(off(critical), "critical").when(off(warning), "warning").when(off(info), "info")
    return items.withColumn("severity", level).filter(c("severity").isNotNull())


# -- deadlines and follow-ups --------------------------------------------------


def deadlines(items: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    """``bucket`` and ``days_late`` of everything with a due time, soonest first; at most ``days`` ahead, if given."""
    late = F.datediff(day_of(as_of), F.to_date("due"))
    bucket = (
        F.when(late > 0, "overdue").when(late == 0, "today").when(late == -1, "tomorrow").when(late >= -7, "this week").otherwise("later")
    )
    near = F.col("due").isNotNull() if days is None else late >= -days
    return items.filter(near).select("*", bucket.alias("bucket"), late.alias("days_late")).orderBy("due", "id")


def event_deadlines(events: DataFrame) -> DataFrame:
    """Meetings whose title or description speaks of a deadline."""
    text = F.concat_ws(" ", "summary", "description")
    return events.filter(text.rlike(DEADLINE_WORDS))


def deadline_mentions(docs: DataFrame, since: str) -> DataFrame:
    """Messages that name a deadline and a day."""
    rows = docs.filter(F.col("event_ts") >= ts(since))
    return rows.filter(F.col("text").rlike(DEADLINE_PHRASE)).withColumn("when_said", F.lower(F.regexp_extract("text", DEADLINE_PHRASE, 1)))


def mail_followups(mails: DataFrame, me: str, as_of: str, depth: int | None = None) -> DataFrame:
    """Threads whose last mail is mine: nobody has answered yet; only of ``depth`` mails, if given."""
    last = mails.groupBy("thread_id").agg(
        F.max_by(F.struct("id", "sender", "subject", "sent_at", "recipients_text"), F.struct("sent_at", "id")).alias("m"), F.count(F.lit(1)).alias("depth")
    )
    rows = last.select("thread_id", "depth", "m.*").filter((F.lower("sender") == me.lower()) & ~F.col("recipients_text").rlike(AUTOMATED))
    rows = rows if depth is None else rows.filter(F.col("depth") == depth)
    return rows.select("*", days_since(F.col("sent_at"), ts(as_of)).alias("days_waiting"), F.col("subject").contains("?").alias("asks"))


def unanswered(rows: DataFrame, me: str, group: str, seq: str) -> DataFrame:
    """My questions in a group (thread, parent) with nothing later by others.

    Needs only the last row by others per group, which is summed map-side.
    """
    others = rows.filter(~F.col("author").eqNullSafe(me)).groupBy(group).agg(F.max(seq).alias("_last_other"))
    mine = rows.filter((F.col("author") == me) & F.col("text").rlike(QUESTION)).join(others, group, "left")
    return mine.filter(F.col("_last_other").isNull() | (F.col("_last_other") <= F.col(seq))).drop("_last_other")


def chat_followups(msgs: DataFrame, me: str) -> DataFrame:
    return unanswered(msgs, me, "thread", "ts")


def comment_followups(comments: DataFrame, me: str) -> DataFrame:
    return unanswered(comments, me, "parent_id", "seq")


# -- stale items ---------------------------------------------------------------


def cutoff(as_of: str, days: int) -> Column:
    return ts(as_of) - F.expr(f"INTERVAL '{days}' DAY")


def stale_issues(issues: DataFrame, as_of: str, days: int) -> DataFrame:
    rows = issues.filter(is_open(F.col("status")) & (F.col("updated") < cutoff(as_of, days)))
    return rows.orderBy("updated", "issue_key")


def stale_docs(docs: DataFrame, as_of: str, days: int) -> DataFrame:
    rows = docs.filter(F.col("is_owner") & (F.col("event_ts") < cutoff(as_of, days)))
    return rows.withColumn("forgotten", F.col("title").rlike(DRAFT_WORDS)).orderBy("event_ts", "id")


def stale_threads(msgs: DataFrame, me: str, as_of: str, days: int) -> DataFrame:
    """Threads I took part in that ask something and went quiet."""
    per = msgs.groupBy("thread").agg(
        F.max("event_ts").alias("last_at"), F.bool_or(F.coalesce(F.col("author") == me, F.lit(False))).alias("mine"),
        F.bool_or(F.col("text").rlike(QUESTION)).alias("asks"), F.count(F.lit(1)).alias("n"),
    )
    return per.filter(F.col("mine") & F.col("asks") & (F.col("last_at") < cutoff(as_of, days))).drop("mine", "asks")


# -- topic context -------------------------------------------------------------


def timeline(hits: DataFrame) -> DataFrame:
    """Hits of each topic in time order, marked first mention and last state."""
    edge = hits.groupBy("qid").agg(
        F.min(F.struct("event_ts", "id")).alias("_a"), F.max(F.struct("event_ts", "id")).alias("_z"), F.count(F.lit(1)).alias("n_hits")
    )
    return hits.join(edge, "qid").select(
        "qid", "id", "event_ts", "n_hits", (F.col("id") == F.col("_a.id")).alias("first_mention"), (F.col("id") == F.col("_z.id")).alias("last_state")
    ).orderBy("qid", "event_ts", "id")


def key_people(hits: DataFrame, roles: dict[str, str], at: str = "event_ts") -> DataFrame:
    """People with the roles they have in the hits; ``roles`` maps column to role."""
    long = hits.withColumns({role: F.col(col) for col, role in roles.items()}).unpivot([at], list(roles.values()), "role", "person")
    return long.filter(F.col("person").isNotNull()).groupBy("person").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.max(at).alias("last_active"), F.count(F.lit(1)).alias("n")
    )


# -- priorities ----------------------------------------------------------------


def priority_score(items: DataFrame, as_of: str) -> DataFrame:
    """0 to 10 from urgency, importance, staleness, context and effort.

    ``items`` has due, priority, from_manager, mentioned, updated, meets_today, effort_min.
    """
    c = F.col
    late = F.datediff(day_of(as_of), F.to_date("due"))
    urgency = (
        F.when(late > 3, 10).when(late >= 1, 8).when(late == 0, 7).when(late == -1, 5).when(late >= -7, 3).otherwise(1)
    )
    importance = (
        F.when(c("priority").isin("Critical", "Blocker"), 10).when(c("from_manager"), 8).when(c("priority") == "High", 7)
        .when(c("mentioned"), 6).when(c("priority") == "Medium", 4).otherwise(2)
    )
    days = days_since(c("updated"), ts(as_of))
    staleness = F.when(days > 14, 10).when(days >= 7, 7).when(days >= 3, 4).otherwise(1)
    context = F.when(c("meets_today"), 10).otherwise(0)
    effort = F.when(c("effort_min") < 15, 10).otherwise(0)
    total = urgency * 30 + importance * 25 + staleness * 20 + context * 15 + effort * 10
    return items.withColumn("score", total / F.lit(100.0))


def priority_queue(items: DataFrame, n: int = QUEUE) -> DataFrame:
    """Best ``n`` items, each once however many query sets returned it."""
    one = items.groupBy("id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_sets"))
    return one.orderBy(F.desc("score"), "id").limit(n)


def project_status(items: DataFrame, as_of: str, statuses=("To Do", "In Progress", "Done", "Blocked")) -> DataFrame:
    """Per project: items by status, closed in the last week, blockers, urgent."""
    counts = items.groupBy("project").pivot("status", list(statuses)).agg(F.count(F.lit(1))).na.fill(0, list(statuses))
    done = F.col("status").isin(CLOSED)
    more = items.groupBy("project").agg(
        F.count_if(~done).alias("n_open"),
        F.count_if(done & (F.col("updated") >= cutoff(as_of, 7))).alias("closed_7d"),
        F.count_if(F.col("blocked") & ~done).alias("blockers"),
        F.count_if(F.col("priority").isin("Critical", "High") & ~done).alias("urgent"),
        F.min(F.when(~done & (F.col("due") >= ts(as_of)), F.col("due"))).alias("next_due"),
    )
    return counts.join(more, "project")


def role_snapshot(projects: DataFrame, items: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Full for active projects, key changes for informed ones, none for muted.

    A key change is one of the last days that closed, blocked or is urgent.
    """
    rows = items.join(projects.select("project", "my_role"), "project")
    fresh = F.col("updated") >= cutoff(as_of, days)
    key = fresh & (F.col("status").isin(CLOSED) | F.col("blocked") | F.col("priority").isin("Critical", "High"))
    return rows.filter((F.col("my_role") == "active") | ((F.col("my_role") == "informed") & F.coalesce(key, F.lit(False))))


def urgency_tier(as_of: str) -> Column:
    """1 overdue, 2 today, 3 blockers, 4 meeting prep, 5 response, 6 started, 7 high this week, 8 rest."""
    c = F.col
    left = F.datediff(F.to_date("due"), day_of(as_of))
    prep = (c("meeting_at") >= ts(as_of)) & (c("meeting_at") <= ts(as_of) + F.expr("INTERVAL '4' HOUR"))
    return (
        F.when(left < 0, 1).when(left == 0, 2).when(c("blocked"), 3).when(prep, 4).when(c("needs_response"), 5)
        .when(c("status") == "In Progress", 6).when(c("priority").isin("Critical", "High") & (left <= 7), 7).otherwise(8)
    )


def daily_priorities(items: DataFrame, as_of: str) -> DataFrame:
    """Open items in order of tier, role, priority, newest update.

    Places are counted over ranges of that order, so a full ranking needs no
    single sorted task.
    """
    rows = items.filter(is_open(F.col("status"))).withColumn("tier", urgency_tier(as_of))
    role = F.when(F.col("my_role") == "active", 0).otherwise(1)
    return numbered(rows, [], [F.col("tier"), role, priority_rank(F.col("priority")), F.desc("updated"), F.asc("id")], "place")


def overlaps(events: DataFrame) -> DataFrame:
    """Pairs of one person's meetings that run at the same time.

    Meetings meet in the hours they touch; a pair counts in the hour in which
    the later one starts, so it comes out once.
    """
    hours = F.sequence(F.date_trunc("hour", "start_at"), F.date_trunc("hour", "end_at"), F.expr("INTERVAL 1 HOUR"))
    rows = events.select("person", "meeting_id", "start_at", "end_at", F.explode(hours).alias("hour"))
    a = rows.select("person", "hour", F.col("meeting_id").alias("a_id"), F.col("start_at").alias("a_start"), F.col("end_at").alias("a_end"))
    # b starts in this hour, and not before a
    b = rows.filter(F.date_trunc("hour", "start_at") == F.col("hour")).select(
        "person", "hour", F.col("meeting_id").alias("b_id"), F.col("start_at").alias("b_start"), F.col("end_at").alias("b_end")
    )
    later = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a_id") < F.col("b_id")))
    return a.join(b, ["person", "hour"]).filter(later & (F.col("a_end") > F.col("b_start")) & (F.col("b_end") > F.col("a_start"))).select(
        "person", "a_id", "b_id"
    )


def competing(items: DataFrame, as_of: str, person: str = "assignee") -> DataFrame:
    """Due today or overdue, per person over projects; a risk from 3 projects."""
    due = items.filter(is_open(F.col("status")) & (F.to_date("due") <= day_of(as_of)))
    per = due.groupBy(person, "project").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(person).agg(F.sum("n").alias("n_due"), F.count(F.lit(1)).alias("n_projects"))
    return out.withColumn("switching", F.col("n_projects") >= 3)


def free_gaps(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Gaps of at least an hour between a person's meetings of one day.

    Meetings with the same start are folded to the latest end first, so a
    person's day is at most one row per second.
    """
    starts = events.groupBy("person", F.to_date("start_at").alias("day"), "start_at").agg(F.max("end_at").alias("end_at"))
    w = Window.partitionBy("person", "day").orderBy("start_at")
    busy = starts.withColumn("until", F.max("end_at").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gaps = busy.select("person", "day", F.col("until").alias("gap_from"), F.lead("start_at").over(w).alias("gap_to"))
    length = ((F.unix_millis(F.col("gap_to").cast("timestamp")) - F.unix_millis(F.col("gap_from").cast("timestamp"))) / 60000)
    return gaps.withColumn("gap_min", length).filter(F.col("gap_min") >= minutes)


def focus_blocks(events: DataFrame, tasks: DataFrame, per_day: int = 24) -> DataFrame:
    """The longest gap of a person's day gets their first task, and so on.

    Gaps of an hour or more are at most 24 a day, so are the tasks to place.
    """
    longest = Window.partitionBy("person", "day").orderBy(F.desc("gap_min"), "gap_from")
    gaps = free_gaps(events).withColumn("place", F.row_number().over(longest))
    first = Window.partitionBy("person").orderBy(F.desc("score"), "task_id")
    queue = tasks.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_day)
    return gaps.join(queue.select("person", "place", "task_id"), ["person", "place"], "left")


def needs_response(docs: DataFrame) -> DataFrame:
    """Open questions to me: direct ones first, then for information; oldest first."""
    return docs.withColumn("rank", F.when(F.col("direct"), 0).otherwise(1)).orderBy("rank", "event_ts", "id")


def capacity(tasks: DataFrame, events: DataFrame, hours: float = 8.0) -> DataFrame:
    """Effort of a person's urgent tasks against the day's time outside meetings."""
    work = tasks.groupBy("person").agg(F.sum("effort_min").alias("effort_min"))
    length = (F.unix_millis(F.col("end_at").cast("timestamp")) - F.unix_millis(F.col("start_at").cast("timestamp"))) / 60000
    meet = events.groupBy("person").agg(F.sum(length).alias("meeting_min"))
    both = work.join(meet, "person", "full_outer").na.fill(0, ["effort_min", "meeting_min"])
    free = F.greatest(F.lit(0.0), F.lit(hours * 60) - F.col("meeting_min"))
    return both.withColumn("free_min", free).withColumn("overloaded", F.col("effort_min") > F.col("free_min"))


# -- week ----------------------------------------------------------------------


def week_metrics(docs: DataFrame, start: str, end: str) -> DataFrame:
    """Figures of a week; ``docs`` has item, thread, channel, status beside the rest."""
    src = F.col("source")
    per = docs.filter(between(F.col("event_ts"), start, end)).groupBy(
        "source", F.when(src == "jira", F.col("item")).when(src == "gmail", F.col("thread")).when(src == "slack", F.col("channel")).alias("key")
    ).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status").isin(CLOSED)).alias("done"))
    return per.agg(
        F.coalesce(F.sum(F.when(src == "calendar", F.col("n"))), F.lit(0)).alias("meetings"),
        F.count_if(src == "jira").alias("issues"),
        F.count_if((src == "jira") & F.col("done")).alias("issues_done"),
        F.count_if(src == "gmail").alias("mail_threads"),
        F.coalesce(F.sum(F.when(src.isin("drive", "confluence"), F.col("n"))), F.lit(0)).alias("documents"),
        F.count_if(src == "slack").alias("channels"),
    )


def day_breakdown(docs: DataFrame, start: str, end: str) -> DataFrame:
    rows = docs.filter(between(F.col("event_ts"), start, end))
    return rows.groupBy(F.to_date("event_ts").alias("day"), "source").agg(F.count(F.lit(1)).alias("n"))


def week_extremes(breakdown: DataFrame) -> DataFrame:
    """Busiest and quietest day and the most active source, from the breakdown."""
    days = breakdown.groupBy("day").agg(F.sum("n").alias("n"))
    src = breakdown.groupBy("source").agg(F.sum("n").alias("n"))
    top = src.agg(F.max(F.struct("n", "source"))["source"]).scalar()
    return days.agg(
        F.max(F.struct("n", "day"))["day"].alias("busiest"), F.min(F.struct("n", "day"))["day"].alias("quietest"), F.sum("n").alias("total")
    ).withColumn("top_source", top)


def focus_share(docs: DataFrame, start: str, end: str) -> DataFrame:
    """Share of activity per project, and of deep work and talk within it."""
    rows = docs.filter(between(F.col("event_ts"), start, end))
    total = rows.agg(F.count(F.lit(1))).scalar()
    per = rows.groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source").isin(DEEP_SOURCES)).alias("deep"), F.count_if(F.col("source").isin(TALK_SOURCES)).alias("talk")
    )
    share = lambda x, of: F.round(x * 100.0 / of, 6)
    return per.select(
        "project", "n", share(F.col("n"), total).alias("percent"), share(F.col("deep"), F.col("n")).alias("deep_percent"), share(F.col("talk"), F.col("n")).alias("talk_percent")
    )


def accomplishments(issues: DataFrame, me: str, start: str, end: str) -> DataFrame:
    """Issues closed in the range, mine first."""
    rows = issues.filter(F.col("status").isin(CLOSED) & between(F.col("updated"), start, end))
    return rows.withColumn("mine", F.coalesce(F.col("assignee") == me, F.lit(False))).orderBy(F.desc("mine"), F.desc("updated"), "issue_key")


def written_docs(docs: DataFrame, start: str, end: str) -> DataFrame:
    """Documents created, or only updated, in the range."""
    made, changed = between(F.col("created_at"), start, end), between(F.col("updated_at"), start, end)
    how = F.when(made, "created").when(changed, "updated")
    return docs.withColumn("how", how).filter(F.col("how").isNotNull())


def decisions(docs: DataFrame, start: str, end: str) -> DataFrame:
    rows = docs.filter(F.col("source").isin(TALK_SOURCES) & between(F.col("event_ts"), start, end))
    return rows.filter(F.col("text").rlike(DECISION_WORDS)).orderBy("event_ts", "id")

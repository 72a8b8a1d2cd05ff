"""Queries W01 to W31: work reports."""

from pyspark.sql import functions as F

from worklore.functions.text import epoch_ms
from worklore.operators import reports as W
from worklore.operators import search as S
from worklore.plans import checks as K
from worklore.plans.q_search import topic_vectors, vectors
from worklore.plans.q_sources import c
from worklore.plans.registry import query
from worklore.plans.standins import DOCS_AS_OF, ME, ME_MAIL, ORDERS_AS_OF, VIEWS, standin

VIEWS["v_dated_docs"] = """
  SELECT v.*, coalesce(updated_at, other_at, created_at) AS event_ts, folder AS project,
         content || CASE doc_id % 9 WHEN 0 THEN ' this is due tomorrow' WHEN 1 THEN ' We agreed to go on.' WHEN 2 THEN ' Deadline is 2024-02-15!' WHEN 3 THEN ' a dueling bystander' ELSE '' END AS text
  FROM v_ranked_docs v"""
VIEWS["v_items"] = """
  SELECT i.*, issue_key AS id, CASE WHEN project IN ('BUILDING', 'MACHINERY') THEN 'active' WHEN project = 'HOUSEHOLD' THEN 'muted' ELSE 'informed' END AS my_role,
         coalesce(reporter = 'Clerk 5', FALSE) AS from_manager, custkey % 17 = 0 AS mentioned, project = 'BUILDING' AS meets_today,
         n % 13 = 0 AS blocked, n % 9 = 0 AS needs_response, CAST(custkey % 150 AS BIGINT) AS person,
         CASE WHEN n % 20 = 1 THEN TIMESTAMP '2001-08-02 00:00:00' + INTERVAL '1' HOUR * CAST(n % 12 AS INT) END AS meeting_at
  FROM v_issues i"""
VIEWS["v_talk"] = """
  SELECT conv_id, turn, 'slack_' || channel_id || '_' || ts AS id, coalesce(thread_ts, ts) AS thread, ts, user_id AS author, text,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(conv_id % 9000 AS INT) + INTERVAL '1' MINUTE * CAST(turn AS INT) AS event_ts
  FROM v_messages"""
NOW = f"TIMESTAMP '{ORDERS_AS_OF}'"
TODAY = "DATE '2001-08-02'"
OPEN = "status NOT IN ('Done', 'Closed', 'Resolved')"
JAN = ("2024-01-08 00:00:00", "2024-01-22 00:00:00")
IN_JAN = "event_ts >= TIMESTAMP '2024-01-08 00:00:00' AND event_ts < TIMESTAMP '2024-01-22 00:00:00'"
RANK = "CASE priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"
TALKER = "U7"


def ms(name):
    return epoch_ms(c(name))


def docs(spark, sf):
    return standin(spark, sf, "v_dated_docs")


def items(spark, sf):
    return standin(spark, sf, "v_items")


@query(
    "w01_activity",
    f"""SELECT source, id, CAST(row_number() OVER (PARTITION BY source ORDER BY relevance_score DESC, id) AS INT) AS place, count(*) OVER (PARTITION BY source) AS n
        FROM v_dated_docs WHERE {IN_JAN} QUALIFY place <= 5""",
)
def w01(spark, sf):
    return W.activity_summary(docs(spark, sf).withColumn("score", c("relevance_score")), *JAN).select("source", "id", "place", "n")


@query(
    "w02_schedule",
    """SELECT meeting_id, epoch_ms(start_at) AS start_ms, start_at >= TIMESTAMP '2024-01-20 09:00:00' AND start_at <= TIMESTAMP '2024-01-20 11:00:00' AS soon
       FROM v_meetings WHERE start_at >= TIMESTAMP '2024-01-20 00:00:00' AND start_at < TIMESTAMP '2024-01-21 00:00:00'""",
)
def w02(spark, sf):
    return W.schedule(standin(spark, sf, "v_meetings"), "2024-01-20 00:00:00", "2024-01-20 09:00:00").select("meeting_id", ms("start_at").alias("start_ms"), "soon")


@query("w03_active_tasks", f"SELECT issue_key, CAST({RANK} AS INT) AS rank FROM v_issues WHERE status IN ('In Progress', 'To Do') OR (assignee = '{ME}' AND {OPEN})")
def w03(spark, sf):
    return W.active_tasks(standin(spark, sf, "v_issues"), ME).select("issue_key", "rank")


@query(
    "w04_recent_messages",
    f"""SELECT id, CASE WHEN text LIKE '%<@{TALKER}>%' THEN 0 ELSE 3 END AS rank FROM v_talk WHERE event_ts >= TIMESTAMP '2024-01-01 12:00:00'
       UNION ALL SELECT message_id, CASE WHEN to_line LIKE '%{ME_MAIL}%' THEN 1 WHEN cc_line LIKE '%boss%' THEN 2 ELSE 3 END FROM v_mail WHERE sent_at >= TIMESTAMP '2024-01-01 12:00:00'""",
)
def w04(spark, sf):
    no, yes = F.lit(False), lambda x: F.coalesce(x, F.lit(False))
    talk = standin(spark, sf, "v_talk").select("id", "event_ts", no.alias("is_dm"), yes(c("text").contains(f"<@{TALKER}>")).alias("mentions_me"), no.alias("to_me"), no.alias("cc_me"))
    mail = standin(spark, sf, "v_mail").select(
        c("message_id").alias("id"), c("sent_at").alias("event_ts"), no.alias("is_dm"), no.alias("mentions_me"),
        yes(c("to_line").contains(ME_MAIL)).alias("to_me"), yes(c("cc_line").contains("boss")).alias("cc_me"),
    )
    return W.recent_messages(talk.unionByName(mail), "2024-01-01 12:00:00").select("id", "rank")


@query("w05_recent_docs", "SELECT id, epoch_ms(event_ts) AS ts_ms FROM v_dated_docs WHERE is_owner AND event_ts >= TIMESTAMP '2023-10-01 00:00:00' ORDER BY event_ts DESC, id LIMIT 20")
def w05(spark, sf):
    return W.recent_docs(docs(spark, sf), "2023-10-01 00:00:00").select("id", ms("event_ts").alias("ts_ms"))


@query(
    "w06_highlights",
    f"""WITH x AS (SELECT id, CASE WHEN {OPEN} AND due < {NOW} THEN 'critical'
              WHEN {OPEN} AND ((due >= {NOW} AND due <= {NOW} + INTERVAL 48 HOUR) OR (priority IN ('Critical', 'Highest', 'High') AND status = 'To Do')) THEN 'warning'
              WHEN updated >= {NOW} - INTERVAL 24 HOUR THEN 'info' END AS severity FROM v_items
          UNION ALL SELECT message_id, CASE WHEN subject LIKE 'Urgent%' AND n <= 1 AND sent_at < {NOW} - INTERVAL 24 HOUR THEN 'critical' WHEN sent_at >= {NOW} - INTERVAL 24 HOUR THEN 'info' END
          FROM (SELECT message_id, subject, sent_at - INTERVAL '8200' DAY AS sent_at, count(*) OVER (PARTITION BY CASE WHEN turn < 3 THEN message_id ELSE thread_id END) AS n FROM v_mail))
        SELECT * FROM x WHERE severity IS NOT NULL""",
)
def w06(spark, sf):
    issue = items(spark, sf).select("id", F.lit("issue").alias("kind"), "status", "priority", "due", c("updated").alias("event_ts"), F.lit("").alias("text"), F.lit(0).cast("long").alias("replies"))
    m = standin(spark, sf, "v_mail").withColumn("_t", F.when(c("turn") < 3, c("message_id")).otherwise(c("thread_id")))
    n = m.groupBy("_t").agg(F.count(F.lit(1)).alias("replies"))
    none = F.lit(None).cast("string")
    mail = m.join(n, "_t").select(
        c("message_id").alias("id"), F.lit("mail").alias("kind"), none.alias("status"), none.alias("priority"), F.lit(None).cast("timestamp_ntz").alias("due"),
        (c("sent_at") - F.expr("INTERVAL '8200' DAY")).alias("event_ts"), c("subject").alias("text"), "replies",
    )
    return W.highlights(issue.unionByName(mail), ORDERS_AS_OF).select("id", "severity")


@query(
    "w07_deadlines",
    f"""SELECT id, CAST(late AS INT) AS days_late, CASE WHEN late > 0 THEN 'overdue' WHEN late = 0 THEN 'today' WHEN late = -1 THEN 'tomorrow' WHEN late >= -7 THEN 'this week' ELSE 'later' END AS bucket
       FROM (SELECT id, date_diff('day', CAST(due AS DATE), {TODAY}) AS late FROM v_items WHERE {OPEN} AND due IS NOT NULL
             UNION ALL SELECT meeting_id, date_diff('day', CAST(start_at AS DATE), {TODAY}) FROM v_meetings WHERE description IS NOT NULL)""",
)
def w07(spark, sf):
    open_items = items(spark, sf).filter(W.is_open(c("status"))).select("id", "due")
    events = W.event_deadlines(standin(spark, sf, "v_meetings")).select(c("meeting_id").alias("id"), c("start_at").alias("due"))
    return W.deadlines(open_items.unionByName(events), ORDERS_AS_OF).select("id", "bucket", "days_late")


@query(
    "w07_horizon",
    f"""SELECT id, CAST(late AS INT) AS days_late FROM (SELECT id, date_diff('day', CAST(due AS DATE), {TODAY}) AS late FROM v_items WHERE {OPEN} AND due IS NOT NULL) WHERE late >= -14""",
)
def w07_horizon(spark, sf):
    """Only what is due in the next two weeks, or late."""
    open_items = items(spark, sf).filter(W.is_open(c("status"))).select("id", "due")
    return W.deadlines(open_items, ORDERS_AS_OF, days=14).select("id", "days_late")


@query(
    "w08_deadline_mentions",
    """SELECT id, CASE doc_id % 9 WHEN 0 THEN 'tomorrow' ELSE '2024-02-15' END AS when_said FROM v_dated_docs
       WHERE doc_id % 9 IN (0, 2) AND event_ts >= TIMESTAMP '2023-06-01 00:00:00'""",
)
def w08(spark, sf):
    return W.deadline_mentions(docs(spark, sf), "2023-06-01 00:00:00").select("id", "when_said")


@query(
    "w09_mail_followups",
    f"""WITH last AS (SELECT *, count(*) OVER (PARTITION BY thread_id) AS depth FROM v_mail QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC, message_id DESC) = 1)
        SELECT thread_id, message_id AS id, depth, CAST(CASE WHEN sent_at IS NULL THEN 999 ELSE greatest(0, floor((epoch_ms(TIMESTAMP '{DOCS_AS_OF}') - epoch_ms(sent_at)) / 86400000.0)) END AS BIGINT) AS days_waiting
        FROM last WHERE lower(sender) IN ('user4@gmail.com', 'user0@gmail.com', 'user8@gmail.com')""",
)
def w09(spark, sf):
    m = standin(spark, sf, "v_mail").select(c("message_id").alias("id"), "thread_id", "sender", "subject", "sent_at", c("to_line").alias("recipients_text"))
    out = None
    for me in ("user4@gmail.com", "user0@Gmail.com", "USER8@gmail.com"):
        part = W.mail_followups(m, me, DOCS_AS_OF).select("thread_id", "id", "depth", "days_waiting")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "w09_thread_depth",
    """SELECT thread_id, message_id AS id FROM (SELECT *, count(*) OVER (PARTITION BY thread_id) AS depth FROM v_mail
       QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC, message_id DESC) = 1) WHERE depth = 3 AND lower(sender) IN ('user6@yahoo.com', 'user4@gmail.com')""",
)
def w09_depth(spark, sf):
    """Unanswered threads of one depth (the given tables have none of a single mail)."""
    m = standin(spark, sf, "v_mail").select(c("message_id").alias("id"), "thread_id", "sender", "subject", "sent_at", c("to_line").alias("recipients_text"))
    both = [W.mail_followups(m, me, DOCS_AS_OF, depth=3).select("thread_id", "id") for me in ("user6@Yahoo.com", "user4@gmail.com")]
    return both[0].unionByName(both[1])


QUESTION = r"(?i)(\?|\bcan you\b|\bplease\b|\bthoughts on\b)"


@query(
    "w10_chat_followups",
    f"""SELECT m.id FROM (SELECT t.*, v.role FROM v_talk t JOIN v_messages v ON t.conv_id = v.conv_id AND t.turn = v.turn) m
        LEFT JOIN (SELECT conv_id, max(turn) AS last_other FROM v_messages WHERE role <> 'user' GROUP BY conv_id) o ON o.conv_id = m.conv_id
        WHERE m.role = 'user' AND regexp_matches(m.text, '{QUESTION}') AND (last_other IS NULL OR last_other <= m.turn)""",
)
def w10(spark, sf):
    roles = standin(spark, sf, "v_messages").select("conv_id", "turn", c("role").alias("author"))
    talk = standin(spark, sf, "v_talk").drop("author").join(roles, ["conv_id", "turn"])
    return W.chat_followups(talk, "user").select("id")


VIEWS["v_notes"] = """
  SELECT 'n' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) AS id, 'ORD-' || CAST(l_orderkey AS STRING) AS parent_id,
         'Clerk ' || CAST(l_suppkey % 5 AS STRING) AS author, l_linenumber AS seq, CASE WHEN l_partkey % 2 = 0 THEN 'Can you look?' ELSE 'fine' END AS text
  FROM {lineitem}"""


@query(
    "w11_comment_followups",
    """SELECT m.id, m.parent_id FROM v_notes m LEFT JOIN (SELECT parent_id, max(seq) AS last_other FROM v_notes WHERE author <> 'Clerk 3' GROUP BY parent_id) o ON m.parent_id = o.parent_id
       WHERE m.author = 'Clerk 3' AND text = 'Can you look?' AND (last_other IS NULL OR last_other <= m.seq)""",
)
def w11(spark, sf):
    return W.comment_followups(standin(spark, sf, "v_notes"), "Clerk 3").select("id", "parent_id")


@query("w12_stale_issues", f"SELECT issue_key, epoch_ms(updated) AS updated_ms FROM v_issues WHERE {OPEN} AND updated < {NOW} - INTERVAL 30 DAY")
def w12(spark, sf):
    return W.stale_issues(standin(spark, sf, "v_issues"), ORDERS_AS_OF, 30).select("issue_key", ms("updated").alias("updated_ms"))


@query(
    "w13_stale_docs",
    """SELECT id, doc_id % 2 = 0 AS forgotten FROM v_dated_docs WHERE is_owner AND event_ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 60 DAY""",
)
def w13(spark, sf):
    rows = docs(spark, sf).withColumn("title", F.when(c("doc_id") % 2 == 0, F.concat(F.lit("WIP: "), c("folder"))).otherwise(c("folder")))
    return W.stale_docs(rows, DOCS_AS_OF, 60).select("id", "forgotten")


@query(
    "w14_stale_threads",
    f"""SELECT thread, epoch_ms(max(event_ts)) AS last_ms, count(*) AS n FROM v_talk GROUP BY thread
        HAVING bool_or(coalesce(author = 'U7' OR author = 'U13', FALSE)) AND bool_or(regexp_matches(text, '{QUESTION}')) AND max(event_ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY""",
)
def w14(spark, sf):
    talk = standin(spark, sf, "v_talk").withColumn("author", F.when(c("author") == "U13", "U7").otherwise(c("author")))
    return W.stale_threads(talk, "U7", DOCS_AS_OF, 10).select("thread", ms("last_at").alias("last_ms"), "n")


@query(
    "w15_timeline",
    f"""WITH {K.KNN_SQL}, h AS (SELECT CAST(qtopic AS INT) AS qid, d.id, d.event_ts FROM near n JOIN v_dated_docs d ON n.id = d.id)
        SELECT qid, id, count(*) OVER (PARTITION BY qid) AS n_hits, row_number() OVER (PARTITION BY qid ORDER BY event_ts, id) = 1 AS first_mention,
               row_number() OVER (PARTITION BY qid ORDER BY event_ts DESC, id DESC) = 1 AS last_state FROM h""",
)
def w15(spark, sf):
    hits = S.knn(vectors(spark, sf), topic_vectors(spark, sf).select(c("topic").alias("qid"), "embedding")).join(docs(spark, sf).select("id", "event_ts"), "id")
    return W.timeline(hits).drop("event_ts")


@query(
    "w16_key_people",
    """WITH l AS (SELECT reporter AS person, 'creator' AS role, updated FROM v_items UNION ALL SELECT assignee, 'assignee', updated FROM v_items
                UNION ALL SELECT 'Clerk ' || (custkey % 40), 'commenter', updated FROM v_items)
       SELECT person, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, epoch_ms(max(updated)) AS last_ms, count(*) AS n FROM l WHERE person IS NOT NULL GROUP BY person""",
)
def w16(spark, sf):
    rows = items(spark, sf).withColumn("commenter_name", F.concat(F.lit("Clerk "), (c("custkey") % 40)))
    out = W.key_people(rows, {"reporter": "creator", "assignee": "assignee", "commenter_name": "commenter"}, "updated")
    return out.select("person", "roles", ms("last_active").alias("last_ms"), "n")


SCORE = f"""((CASE WHEN late > 3 THEN 10 WHEN late >= 1 THEN 8 WHEN late = 0 THEN 7 WHEN late = -1 THEN 5 WHEN late >= -7 THEN 3 ELSE 1 END) * 30
   + (CASE WHEN priority = 'Critical' THEN 10 WHEN from_manager THEN 8 WHEN priority = 'High' THEN 7 WHEN mentioned THEN 6 WHEN priority = 'Medium' THEN 4 ELSE 2 END) * 25
   + (CASE WHEN days > 14 THEN 10 WHEN days >= 7 THEN 7 WHEN days >= 3 THEN 4 ELSE 1 END) * 20
   + CASE WHEN meets_today THEN 150 ELSE 0 END + CASE WHEN effort_min < 15 THEN 100 ELSE 0 END) / 100.0"""
SCORED = f"""scored AS (SELECT *, {SCORE} AS score FROM (SELECT *, date_diff('day', CAST(due AS DATE), {TODAY}) AS late,
   CASE WHEN updated IS NULL THEN 999 ELSE greatest(0, floor((epoch_ms({NOW}) - epoch_ms(updated)) / 86400000.0)) END AS days FROM v_items))"""


@query("w17_priority_score", f"WITH {SCORED} SELECT id, round(score, 6) AS score FROM scored")
def w17(spark, sf):
    return W.priority_score(items(spark, sf), ORDERS_AS_OF).select("id", F.round("score", 6).alias("score"))


@query(
    "w18_priority_queue",
    f"""WITH {SCORED} SELECT id, round(score, 6) AS score, 1 + CAST(priority = 'Critical' AS BIGINT) + CAST(mentioned AS BIGINT) AS n_sets
        FROM (SELECT * REPLACE (coalesce(priority, '') AS priority) FROM scored) WHERE status <> 'Done' ORDER BY score DESC, id LIMIT 30""",
)
def w18(spark, sf):
    rows = W.priority_score(items(spark, sf), ORDERS_AS_OF).filter(c("status") != "Done")
    sets = rows.unionByName(rows.filter(c("priority") == "Critical")).unionByName(rows.filter(c("mentioned")))
    return W.priority_queue(sets).select("id", F.round("score", 6).alias("score"), "n_sets")


@query(
    "w19_project_status",
    f"""SELECT project, count(*) FILTER (status = 'To Do') AS to_do, count(*) FILTER (status = 'In Progress') AS in_progress, count(*) FILTER (status = 'Done') AS done,
        count(*) FILTER ({OPEN}) AS n_open, count(*) FILTER (status = 'Done' AND updated >= {NOW} - INTERVAL 7 DAY) AS closed_7d, count(*) FILTER (blocked AND {OPEN}) AS blockers,
        count(*) FILTER (priority IN ('Critical', 'High') AND {OPEN}) AS urgent, epoch_ms(min(due) FILTER ({OPEN} AND due >= {NOW})) AS next_due_ms FROM v_items GROUP BY project""",
)
def w19(spark, sf):
    s = W.project_status(items(spark, sf), ORDERS_AS_OF)
    return s.select("project", c("To Do").alias("to_do"), c("In Progress").alias("in_progress"), c("Done").alias("done"), "n_open", "closed_7d", "blockers", "urgent", ms("next_due").alias("next_due_ms"))


@query(
    "w20_role_snapshot",
    f"""SELECT id, my_role FROM v_items WHERE my_role = 'active' OR (my_role = 'informed' AND updated >= {NOW} - INTERVAL 7 DAY
        AND (status IN ('Done', 'Closed', 'Resolved') OR blocked OR coalesce(priority IN ('Critical', 'High'), FALSE)))""",
)
def w20(spark, sf):
    rows = items(spark, sf)
    return W.role_snapshot(rows.select("project", "my_role").distinct(), rows.drop("my_role"), ORDERS_AS_OF).select("id", "my_role")


@query(
    "w21_daily_priorities",
    f"""WITH x AS (SELECT *, date_diff('day', {TODAY}, CAST(due AS DATE)) AS days_to FROM v_items WHERE {OPEN}),
        t AS (SELECT *, CASE WHEN days_to < 0 THEN 1 WHEN days_to = 0 THEN 2 WHEN blocked THEN 3 WHEN meeting_at >= {NOW} AND meeting_at <= {NOW} + INTERVAL 4 HOUR THEN 4
              WHEN needs_response THEN 5 WHEN status = 'In Progress' THEN 6 WHEN priority IN ('Critical', 'High') AND days_to <= 7 THEN 7 ELSE 8 END AS tier FROM x)
        SELECT id, CAST(tier AS INT) AS tier, row_number() OVER (ORDER BY tier, my_role <> 'active', {RANK}, updated DESC, id) AS place FROM t""",
)
def w21(spark, sf):
    return W.daily_priorities(items(spark, sf), ORDERS_AS_OF).select("id", "tier", "place")


def meetings(spark, sf):
    return standin(spark, sf, "v_meetings").withColumn("person", c("user_id"))


@query(
    "w22_overlaps",
    """SELECT a.user_id AS person, least((a.start_at, a.meeting_id), (b.start_at, b.meeting_id))[2] AS a_id, greatest((a.start_at, a.meeting_id), (b.start_at, b.meeting_id))[2] AS b_id
       FROM v_meetings a JOIN v_meetings b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.start_at < b.end_at AND b.start_at < a.end_at""",
)
def w22(spark, sf):
    return W.overlaps(meetings(spark, sf))


@query(
    "w23_competing",
    f"""SELECT assignee, count(*) AS n_due, count(DISTINCT project) AS n_projects, count(DISTINCT project) >= 3 AS switching FROM (
        SELECT CASE WHEN assignee IS NOT NULL THEN 'T' || (custkey % 50) END AS assignee, project, due, status FROM v_items) WHERE {OPEN} AND CAST(due AS DATE) <= {TODAY} GROUP BY assignee""",
)
def w23(spark, sf):
    rows = items(spark, sf).withColumn("assignee", F.when(c("assignee").isNotNull(), F.concat(F.lit("T"), (c("custkey") % 50))))
    return W.competing(rows, ORDERS_AS_OF)


GAPS = """busy AS (SELECT user_id AS person, CAST(start_at AS DATE) AS day, start_at, max(end_at) OVER (PARTITION BY user_id, CAST(start_at AS DATE) ORDER BY start_at) AS until,
              lead(start_at) OVER (PARTITION BY user_id, CAST(start_at AS DATE) ORDER BY start_at) AS nxt FROM v_meetings),
   gaps AS (SELECT person, day, until, nxt, (epoch_ms(nxt) - epoch_ms(until)) / 60000.0 AS gap_min FROM busy WHERE (epoch_ms(nxt) - epoch_ms(until)) / 60000.0 >= 60)"""


@query(
    "w24_focus_blocks",
    f"""WITH {GAPS}, {SCORED}, g AS (SELECT *, row_number() OVER (PARTITION BY person, day ORDER BY gap_min DESC, until) AS place FROM gaps),
        q AS (SELECT person, id AS task_id, row_number() OVER (PARTITION BY person ORDER BY round(score, 6) DESC, id) AS place FROM scored)
        SELECT g.person, strftime(g.day, '%Y-%m-%d') AS day, CAST(g.place AS INT) AS place, CAST(round(gap_min * 60000) AS BIGINT) AS gap_ms, q.task_id FROM g LEFT JOIN q ON g.person = q.person AND g.place = q.place""",
)
def w24(spark, sf):
    tasks = W.priority_score(items(spark, sf), ORDERS_AS_OF).select("person", c("id").alias("task_id"), F.round("score", 6).alias("score"))
    out = W.focus_blocks(meetings(spark, sf), tasks)
    return out.select("person", F.date_format("day", "yyyy-MM-dd").alias("day"), "place", F.round(c("gap_min") * 60000).cast("long").alias("gap_ms"), "task_id")


@query(
    "w25_needs_response",
    f"""SELECT id, CASE WHEN text LIKE '%<@{TALKER}>%' THEN 0 ELSE 1 END AS rank FROM v_talk WHERE regexp_matches(text, '{QUESTION}')""",
)
def w25(spark, sf):
    open_q = standin(spark, sf, "v_talk").filter(c("text").rlike(W.QUESTION)).withColumn("direct", c("text").contains(f"<@{TALKER}>"))
    return W.needs_response(open_q).select("id", "rank")


@query(
    "w26_capacity",
    f"""WITH w AS (SELECT person, sum(effort_min) AS effort FROM v_items WHERE {OPEN} AND CAST(due AS DATE) <= {TODAY} GROUP BY person),
        m AS (SELECT user_id AS person, sum((epoch_ms(end_at) - epoch_ms(start_at)) / 60000.0) AS meet FROM v_meetings WHERE start_at >= TIMESTAMP '2024-01-20 00:00:00' AND start_at < TIMESTAMP '2024-01-21 00:00:00' GROUP BY user_id)
        SELECT coalesce(w.person, m.person) AS person, CAST(coalesce(effort, 0) AS BIGINT) AS effort_min, CAST(round(coalesce(meet, 0) * 60000) AS BIGINT) AS meeting_ms,
               CAST(round(greatest(0, 480 - coalesce(meet, 0)) * 60000) AS BIGINT) AS free_ms, coalesce(effort, 0) > greatest(0, 480 - coalesce(meet, 0)) AS overloaded FROM w FULL JOIN m ON w.person = m.person""",
)
def w26(spark, sf):
    urgent = items(spark, sf).filter(W.is_open(c("status")) & (F.to_date("due") <= W.day_of(ORDERS_AS_OF)))
    today = meetings(spark, sf).filter(W.between(c("start_at"), "2024-01-20 00:00:00", "2024-01-21 00:00:00"))
    return W.capacity(urgent, today).select("person", "effort_min", F.round(c("meeting_min") * 60000).cast("long").alias("meeting_ms"), F.round(c("free_min") * 60000).cast("long").alias("free_ms"), "overloaded")


def week_docs(spark, sf):
    return docs(spark, sf).select(
        "source", "event_ts", "id", c("folder").alias("item"), c("author").alias("thread"), c("lang").alias("channel"), "project",
        F.when(c("label_count") == 1, "Done").otherwise("To Do").alias("status"),
    )


@query(
    "w27_week_metrics",
    f"""SELECT count(*) FILTER (source = 'calendar') AS meetings, count(DISTINCT folder) FILTER (source = 'jira') AS issues, count(DISTINCT folder) FILTER (source = 'jira' AND label_count = 1) AS issues_done,
        count(DISTINCT author) FILTER (source = 'gmail') AS mail_threads, count(*) FILTER (source IN ('drive', 'confluence')) AS documents, count(DISTINCT lang) FILTER (source = 'slack') AS channels
        FROM v_dated_docs WHERE {IN_JAN}""",
)
def w27(spark, sf):
    return W.week_metrics(week_docs(spark, sf), *JAN)


@query("w28_day_breakdown", f"SELECT strftime(event_ts, '%Y-%m-%d') AS day, source, count(*) AS n FROM v_dated_docs WHERE {IN_JAN} GROUP BY ALL")
def w28(spark, sf):
    return W.day_breakdown(docs(spark, sf), *JAN).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "source", "n")


@query(
    "w28_extremes",
    f"""WITH b AS (SELECT CAST(event_ts AS DATE) AS day, source FROM v_dated_docs WHERE {IN_JAN}), d AS (SELECT day, count(*) AS n FROM b GROUP BY day), s AS (SELECT source, count(*) AS n FROM b GROUP BY source)
        SELECT strftime((SELECT day FROM d ORDER BY n DESC, day DESC LIMIT 1), '%Y-%m-%d') AS busiest, strftime((SELECT day FROM d ORDER BY n, day LIMIT 1), '%Y-%m-%d') AS quietest,
               (SELECT count(*) FROM b) AS total, (SELECT source FROM s ORDER BY n DESC, source DESC LIMIT 1) AS top_source""",
)
def w28_extremes(spark, sf):
    day = lambda n: F.date_format(n, "yyyy-MM-dd").alias(n)
    return W.week_extremes(W.day_breakdown(docs(spark, sf), *JAN)).select(day("busiest"), day("quietest"), "total", "top_source")


@query(
    "w29_focus_share",
    f"""SELECT folder AS project, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM v_dated_docs WHERE {IN_JAN}), 6) AS percent,
        round(count(*) FILTER (source IN ('jira', 'drive', 'confluence')) * 100.0 / count(*), 6) AS deep_percent, round(count(*) FILTER (source IN ('slack', 'gmail')) * 100.0 / count(*), 6) AS talk_percent
        FROM v_dated_docs WHERE {IN_JAN} GROUP BY folder""",
)
def w29(spark, sf):
    return W.focus_share(docs(spark, sf), *JAN)


@query(
    "w30_accomplishments",
    f"""SELECT issue_key, coalesce(assignee = '{ME}', FALSE) AS mine FROM v_issues WHERE status IN ('Done', 'Closed', 'Resolved') AND updated >= TIMESTAMP '2000-01-01 00:00:00' AND updated < TIMESTAMP '2000-07-01 00:00:00'""",
)
def w30(spark, sf):
    return W.accomplishments(standin(spark, sf, "v_issues"), ME, "2000-01-01 00:00:00", "2000-07-01 00:00:00").select("issue_key", "mine")


@query(
    "w30_written_docs",
    """SELECT id, CASE WHEN created_at >= TIMESTAMP '2023-01-03 00:00:00' AND created_at < TIMESTAMP '2023-09-01 00:00:00' THEN 'created' ELSE 'updated' END AS how FROM v_docs
       WHERE (created_at >= TIMESTAMP '2023-01-03 00:00:00' AND created_at < TIMESTAMP '2023-09-01 00:00:00') OR (updated_at >= TIMESTAMP '2023-01-03 00:00:00' AND updated_at < TIMESTAMP '2023-09-01 00:00:00')""",
)
def w30_docs(spark, sf):
    return W.written_docs(docs(spark, sf), "2023-01-03 00:00:00", "2023-09-01 00:00:00").select("id", "how")


@query("w31_decisions", f"SELECT id FROM v_dated_docs WHERE source IN ('slack', 'gmail') AND doc_id % 9 = 1 AND event_ts >= TIMESTAMP '2023-08-01 00:00:00' AND event_ts < TIMESTAMP '2024-02-01 00:00:00'")
def w31(spark, sf):
    return W.decisions(docs(spark, sf), "2023-08-01 00:00:00", "2024-02-01 00:00:00").select("id")

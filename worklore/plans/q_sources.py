"""Queries S01 to S32: landed records to documents."""

from pyspark.sql import functions as F

from worklore.functions.html import SPACE_STEPS, TAG_STEPS, html_to_text
from worklore.functions.markup import page_text
from worklore.functions.text import epoch_ms
from worklore.plans import raw as R
from worklore.plans.registry import query
from worklore.plans.standins import CHECK_VIEWS, standin, table
from worklore.session import fresh_path, spread_small
from worklore.sources import chat, documents, files, issues, landing, mail, meetings, wiki

c = F.col


def joined(name, sep=","):
    return F.array_join(name, sep)


def ms(name):
    return epoch_ms(c(name))


@query(
    "s01_landing",
    """SELECT issue_key AS key, summary, project, status, n_comments AS n_comments, FALSE AS corrupt FROM v_issues
       UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, TRUE FROM region""",
)
def s01(spark, sf):
    path = fresh_path(spark, "landing")
    R.raw_issues(spark, sf).write.json(path)
    table(spark, sf, "region").select(F.concat(F.lit("{broken "), "r_name").alias("value")).write.mode("append").text(path)
    rows = landing.read_raw(spark, path, "jira")
    return rows.select(
        "key", "fields.summary", c("fields.project.key").alias("project"), c("fields.status.name").alias("status"),
        F.size("fields.comment.comments").alias("n_comments"), c(landing.CORRUPT).isNotNull().alias("corrupt"),
    )


ISSUE_SQL = """SELECT issue_key AS id, summary AS title, project, 'Task' AS issue_type, status, coalesce(priority, 'None') AS priority,
        assignee, coalesce(reporter, 'Unknown') AS reporter, CASE n_labels WHEN 0 THEN '' WHEN 1 THEN 'red' ELSE 'red,blue' END AS labels,
        CASE WHEN n_labels > 0 THEN project ELSE '' END AS components, epoch_ms(created) AS created_ms, epoch_ms(updated) AS updated_ms,
        'https://t.example/browse/' || issue_key AS url FROM v_issues"""


@query("s02_issues", ISSUE_SQL)
def s02(spark, sf):
    d = issues.issues(R.raw_issues(spark, sf), "https://t.example")
    return d.select(
        "id", "title", "project", "issue_type", "status", "priority", "assignee", "reporter", joined("labels").alias("labels"),
        joined("components").alias("components"), ms("created_at").alias("created_ms"), ms("updated_at").alias("updated_ms"), "url",
    )


CHECK_VIEWS["c_comments"] = """
  SELECT issue_key || '_comment_' || (n * 10 + i) AS id, issue_key AS parent_id, project, 'Clerk ' || ((n + i) % 9) AS reporter,
         CASE WHEN i < 2 THEN 'Note ' || n || ' & ' || i ELSE 'plain ' || i END AS body, created, updated, n, i
  FROM v_issues, (SELECT unnest([0, 1, 2]) AS i) WHERE i < n_comments"""


@query(
    "s03_issue_comments",
    """SELECT id, parent_id, project, reporter, 'Comment on ' || parent_id || ' by ' || reporter || ':' || chr(10) || body AS content,
              epoch_ms(created) AS created_ms FROM c_comments""",
)
def s03(spark, sf):
    d = issues.issue_comments(R.raw_issues(spark, sf))
    return d.select("id", "parent_id", "project", "reporter", "content", ms("created_at").alias("created_ms"))


CHECK_VIEWS["c_issue_text"] = """
  SELECT issue_key AS id, '# [' || issue_key || '] ' || summary || chr(10) || chr(10) || '## Metadata' || chr(10) || '- **Type**: Task' || chr(10)
         || '- **Status**: ' || status || chr(10) || '- **Priority**: ' || coalesce(priority, 'None') || chr(10) || '- **Project**: ' || project
         || coalesce(chr(10) || '- **Assignee**: ' || assignee, '') || coalesce(chr(10) || '- **Reporter**: ' || reporter, '')
         || CASE n_labels WHEN 0 THEN '' WHEN 1 THEN chr(10) || '- **Labels**: red' ELSE chr(10) || '- **Labels**: red, blue' END
         || coalesce(chr(10) || chr(10) || '## Description' || chr(10)
                     || CASE WHEN n % 3 = 0 THEN '## Price' || chr(10) || chr(10) || n ELSE description END, '') AS content
  FROM v_issues"""


@query("s04_issue_content", "SELECT id, content FROM c_issue_text")
def s04(spark, sf):
    return issues.issues(R.raw_issues(spark, sf)).select("id", "content")


@query("s05_sprint", "SELECT issue_key AS id, CASE WHEN n_sprints > 0 THEN 'Sprint ' || n_sprints END AS sprint FROM v_issues")
def s05(spark, sf):
    return R.raw_issues(spark, sf).select(c("key").alias("id"), issues.sprint(c("fields.sprint")).alias("sprint"))


@query(
    "s06_links",
    """SELECT issue_key AS from_key, 'Blocks' AS type, 'ORD-' || (n + 1) AS key, 'inward' AS direction FROM v_issues WHERE n_links > 0
       UNION ALL SELECT issue_key, 'Clones', 'ORD-' || (n + 3), 'outward' FROM v_issues WHERE n_links = 2""",
)
def s06(spark, sf):
    return issues.link_edges(R.raw_issues(spark, sf))


# Chat messages with names put in, as the checks see them.
CHECK_VIEWS["c_shown"] = "SELECT user_id, coalesce(nullif(real_name, ''), nullif(name, '')) AS shown FROM v_users"
CHECK_VIEWS["c_chan"] = """
  SELECT ch.channel_id, CASE WHEN is_im AND ch.user_id IS NOT NULL THEN coalesce(s.shown, 'DM with ' || ch.user_id) ELSE ch.name END AS channel,
         is_im, is_mpim, is_private FROM v_channels ch LEFT JOIN c_shown s ON ch.user_id = s.user_id WHERE is_member OR is_im"""
CHECK_VIEWS["c_msg"] = """
  SELECT m.*, m.conv_id % 7 AS up, n1, n2, ch.channel,
         CASE WHEN n1 IS NULL THEN m.text ELSE replace(replace(m.text, '<@U' || (conv_id % 40) || '>', '@' || n1), '<@U9' || turn || '|bob>', '@' || n2) END AS formatted,
         coalesce(a.shown, m.user_id, 'Bot') AS author
  FROM (SELECT x.*, CASE WHEN (conv_id + turn) % 3 = 0 THEN coalesce(s1.shown, 'U' || (conv_id % 40)) END AS n1,
               CASE WHEN (conv_id + turn) % 3 = 0 THEN coalesce(s2.shown, 'U9' || turn) END AS n2
        FROM v_messages x LEFT JOIN c_shown s1 ON s1.user_id = 'U' || (conv_id % 40) LEFT JOIN c_shown s2 ON s2.user_id = 'U9' || turn) m
  LEFT JOIN c_shown a ON a.user_id = m.user_id JOIN c_chan ch ON ch.channel_id = m.channel_id
  WHERE m.user_id IS NOT NULL OR m.subtype = 'bot_message'"""
MSG_COLS = """'slack_' || channel_id || '_' || ts AS id, '#' || channel || ': ' || trim(substring(regexp_replace(formatted, chr(10) || '+', ' ', 'g'), 1, 80)) AS title,
   channel, author, coalesce(user_id, '') AS author_id, epoch_ms(make_timestamp(CAST(CAST(split_part(ts, '.', 1) AS BIGINT) * 1000000 + 100 AS BIGINT))) AS ts_ms,
   coalesce(subtype = 'bot_message', FALSE) AS is_bot, turn % 6 = 5 AS has_attachments,
   CASE WHEN n1 IS NULL THEN '' ELSE n1 || ',' || n2 END AS mentioned"""


def message_columns(d):
    return d.select(
        "id", "title", "channel", "author", "author_id", ms("timestamp").alias("ts_ms"), "is_bot", "has_attachments",
        joined("mentioned_users").alias("mentioned"), "type", F.md5("content").alias("content_hash"),
    )


@query(
    "s07_messages",
    f"""SELECT {MSG_COLS}, CASE WHEN thread_ts IS NULL OR thread_ts = ts THEN 'message' ELSE 'thread_reply' END AS type,
        md5('### Message in #' || channel || chr(10) || '**Author**: ' || author || chr(10) || '**Time**: '
            || strftime(to_timestamp(CAST(split_part(ts, '.', 1) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10) || formatted) AS content_hash
        FROM c_msg""",
)
def s07(spark, sf):
    return message_columns(chat.messages(R.raw_messages(spark, sf), R.chat_users(spark, sf), R.chat_channels(spark, sf)))


@query(
    "s08_mentions",
    "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'U' || (conv_id % 40) || ',U9' || turn ELSE '' END AS ids FROM v_messages",
)
def s08(spark, sf):
    return standin(spark, sf, "v_messages").select("conv_id", "turn", joined(chat.mentions(c("text"))).alias("ids"))


@query("s09_resolve", "SELECT conv_id, turn, formatted, CASE WHEN n1 IS NULL THEN '' ELSE n1 || ',' || n2 END AS names FROM c_msg")
def s09(spark, sf):
    msgs = standin(spark, sf, "v_messages").filter(c("user_id").isNotNull() | (c("subtype") == "bot_message"))
    msgs = msgs.join(R.chat_channels(spark, sf).select("channel_id"), "channel_id", "left_semi")
    out = chat.resolve_mentions(msgs, R.chat_users(spark, sf), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "formatted", joined("mentioned_users").alias("names"))


@query(
    "s10_reactions",
    """WITH r AS (SELECT conv_id, turn, unnest([1, 2, 3, 4]) AS i, unnest(['up', 'eyes', 'heart', 'ok']) AS name,
                         unnest([conv_id % 7, 3, turn, 2]) AS n, n_reactions FROM v_messages),
       k AS (SELECT * FROM r WHERE i <= n_reactions),
       t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, i) AS rk FROM k)
       SELECT m.conv_id, m.turn, CAST(coalesce(sum(n), 0) AS INT) AS total, coalesce(string_agg(name, ',' ORDER BY rk) FILTER (rk <= 3), '') AS top
       FROM v_messages m LEFT JOIN t ON m.conv_id = t.conv_id AND m.turn = t.turn GROUP BY ALL""",
)
def s10(spark, sf):
    rows = R.raw_messages(spark, sf).withColumn("v", F.split("ts", r"\.")[0].cast("long") - 1704067200)
    total, top = chat.reactions(c("reactions"))
    return rows.select(
        F.floor(c("v") / 3600).alias("conv_id"), F.floor(c("v") % 3600 / 60).alias("turn"), total.alias("total"), joined(top).alias("top")
    )


@query(
    "s11_thread_replies",
    f"""SELECT {MSG_COLS}, 'slack_' || channel_id || '_' || thread_ts AS parent_id,
        md5('### Thread Reply in #' || channel || chr(10) || '**Author**: ' || author || chr(10) || '**Time**: '
            || strftime(to_timestamp(CAST(split_part(ts, '.', 1) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')
            || chr(10) || '**Context**: Reply to message ' || thread_ts || chr(10) || chr(10) || formatted) AS content_hash, 'thread_reply' AS type
        FROM c_msg WHERE thread_ts IS NOT NULL AND thread_ts <> ts""",
)
def s11(spark, sf):
    raw = R.raw_messages(spark, sf)
    d = chat.thread_replies(raw, raw, R.chat_users(spark, sf), R.chat_channels(spark, sf))
    return message_columns(d).join(d.select("id", "parent_id"), "id")


@query("s12_channels", "SELECT channel_id, channel AS name FROM c_chan")
def s12(spark, sf):
    return R.chat_channels(spark, sf).select("channel_id", "name")


@query(
    "s13_channel_kind",
    """SELECT CASE WHEN is_im THEN 'dm' WHEN is_mpim THEN 'mpim' WHEN is_private THEN 'private' ELSE 'public' END AS kind, count(*) AS n
       FROM v_messages m JOIN c_chan USING (channel_id) GROUP BY 1""",
)
def s13(spark, sf):
    rows = standin(spark, sf, "v_messages").select("channel_id").join(R.chat_channels(spark, sf), "channel_id")
    return rows.groupBy(chat.channel_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# Mail as the checks see it: cleaned address lines and the chosen body.
CHECK_VIEWS["c_mail"] = r"""
  SELECT *, list_filter(list_transform(string_split(to_line, ','), lambda x: trim(x)), lambda x: x <> '') AS rcpt,
         list_filter(list_transform(string_split(coalesce(cc_line, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS ccs,
         CASE WHEN body_kind = 0 THEN body ELSE trim(regexp_replace(body, '\s+', ' ', 'g')) END AS shown
  FROM v_mail WHERE NOT (trim(body) = '' AND trim(subject) = '')"""


@query(
    "s14_emails",
    """SELECT 'gmail_' || message_id AS id, subject, sender, array_to_string(rcpt, ';') AS recipients, array_to_string(ccs, ';') AS cc,
              labels, thread_id, epoch_ms(sent_at) AS date_ms,
              md5('# Email: ' || subject || chr(10) || '**From**: ' || sender || chr(10) || '**To**: ' || array_to_string(rcpt, ', ')
                  || CASE WHEN len(ccs) > 0 THEN chr(10) || '**CC**: ' || array_to_string(ccs, ', ') ELSE '' END
                  || chr(10) || '**Date**: ' || strftime(sent_at, '%Y-%m-%d %H:%M:%S') || chr(10) || '## Content'
                  || CASE WHEN shown <> '' THEN chr(10) || shown ELSE '' END) AS content_hash FROM c_mail""",
)
def s14(spark, sf):
    d = mail.emails(R.raw_mail(spark, sf))
    return d.select(
        "id", "subject", "sender", joined("recipients", ";").alias("recipients"), joined("cc", ";").alias("cc"),
        joined("labels").alias("labels"), "thread_id", ms("date").alias("date_ms"), F.md5("content").alias("content_hash"),
    )


@query("s15_body", r"SELECT message_id AS id, CASE WHEN body_kind = 0 THEN body ELSE trim(regexp_replace(body, '\s+', ' ', 'g')) END AS body FROM v_mail")
def s15(spark, sf):
    return mail.with_body(R.raw_mail(spark, sf)).select("id", "body")


@query(
    "s16_mail_scope",
    """SELECT 'gmail_' || message_id AS id FROM c_mail WHERE lower(split_part(sender, '@', 2)) IN ('corp.example', 'yahoo.com')
       AND sender IN ('user1@corp.example', 'user1@Corp.example', 'user3@corp.example', 'user5@Corp.example', 'user6@Yahoo.com') AND labels LIKE '%INBOX%'""",
)
def s16(spark, sf):
    d = mail.emails(R.raw_mail(spark, sf))
    people = ["user1@corp.example", "user3@corp.example", "user5@corp.example", "user6@yahoo.com"]
    return mail.email_scope(d, ["Corp.example", "yahoo.com"], people, ["INBOX", "STARRED"]).select("id")


@query("s17_added_ids", "SELECT DISTINCT id FROM (SELECT message_id AS id FROM v_mail UNION ALL SELECT thread_id || '_0' FROM v_mail)")
def s17(spark, sf):
    msg = lambda i: F.struct(F.struct(i.alias("id")).alias("message"))
    history = standin(spark, sf, "v_mail").select(
        F.array(msg(c("message_id")), msg(F.concat("thread_id", F.lit("_0")))).alias("messagesAdded")
    )
    return mail.added_ids(history)


# Folder paths by recursion; a folder met before ends the walk.
CHECK_VIEWS["c_paths"] = """+
  c_walk AS (SELECT folder_id, folder_id AS at, name AS path, [folder_id] AS seen, parent_id FROM v_folders
    UNION ALL SELECT w.folder_id, f.folder_id, f.name || '/' || w.path, list_append(w.seen, f.folder_id), f.parent_id
    FROM c_walk w JOIN v_folders f ON w.parent_id = f.folder_id WHERE NOT list_contains(w.seen, f.folder_id)),
  c_paths AS (SELECT folder_id, path FROM c_walk QUALIFY row_number() OVER (PARTITION BY folder_id ORDER BY len(seen) DESC) = 1)"""


@query(
    "s18_files",
    """WITH p AS (SELECT f.*, coalesce('/' || path, '') || '/' || name AS full_path FROM v_files f LEFT JOIN c_paths c ON f.parent_id = c.folder_id)
       SELECT 'drive_' || file_id AS id, name, full_path AS path, CASE WHEN parent_id IS NULL THEN '/' ELSE coalesce(nullif(substring(full_path, 1, length(full_path) - length(name) - 1), ''), '/') END AS folder_path,
              coalesce(owner, 'Unknown') AS owner, epoch_ms(modified_at) AS modified_ms,
              md5('File: ' || name || chr(10) || 'Path: ' || full_path || chr(10) || chr(10) || body) AS content_hash FROM p""",
)
def s18(spark, sf):
    paths = files.folder_paths(files.folder_chains(R.folder_table(spark, sf)))
    d = files.files(R.raw_files(spark, sf), paths)
    return d.select("id", "name", "path", "folder_path", "owner", ms("modified_at").alias("modified_ms"), F.md5("content").alias("content_hash"))


@query(
    "s19_file_type",
    """SELECT mime_type, count(*) AS n, CASE WHEN mime_type LIKE '%document%' OR mime_type LIKE '%text%' THEN 'document' WHEN mime_type LIKE '%spreadsheet%' THEN 'spreadsheet'
              WHEN mime_type LIKE '%presentation%' THEN 'presentation' WHEN mime_type = 'application/pdf' THEN 'pdf' ELSE 'other' END AS type FROM v_files GROUP BY mime_type""",
)
def s19(spark, sf):
    rows = standin(spark, sf, "v_files").select("mime_type", files.file_type(c("mime_type")).alias("type"))
    return rows.groupBy("mime_type", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s20_mime_gate",
    """SELECT file_id, mime_type = 'text/html' OR lower(body) LIKE '%<html%' OR lower(body) LIKE '%<body%' AS is_html FROM v_files
       WHERE mime_type NOT LIKE 'image/%' AND mime_type <> 'application/zip' AND instr(body, chr(0)) = 0""",
)
def s20(spark, sf):
    return files.mime_gate(standin(spark, sf, "v_files")).select("file_id", "is_html")


@query("s21_folder_paths", "SELECT folder_id, path FROM c_paths")
def s21(spark, sf):
    return files.folder_paths(files.folder_chains(R.folder_table(spark, sf)))


CHECK_VIEWS["c_under"] = """+
  c_down AS (SELECT folder_id FROM v_folders WHERE folder_id IN ('r1', 's3')
    UNION SELECT f.folder_id FROM c_down d JOIN v_folders f ON f.parent_id = d.folder_id),
  c_under AS (SELECT folder_id FROM c_down)"""


def under(spark, sf):
    folders = R.folder_table(spark, sf)
    roots = folders.filter(c("folder_id").isin("r1", "s3")).select(c("folder_id").alias("root_id"))
    return files.descendants(files.folder_chains(folders), roots)


@query("s22_descendants", "SELECT folder_id FROM c_under")
def s22(spark, sf):
    return under(spark, sf)


@query(
    "s23_file_scope",
    """SELECT file_id FROM v_files WHERE mime_type <> 'application/vnd.google-apps.folder' AND NOT trashed
         AND modified_at > TIMESTAMP '2023-08-20 00:00:00'
         AND (parent_id IN (SELECT folder_id FROM c_under) OR owned_by_me OR shared_with_me OR starred)""",
)
def s23(spark, sf):
    return files.file_scope(
        standin(spark, sf, "v_files"), "2023-08-20 00:00:00", my_files=True, shared_with_me=True, starred=True, drive_folders=under(spark, sf)
    ).select("file_id")


@query(
    "s24_wiki_pages",
    """SELECT 'confluence_' || page_id AS id, page_type AS type, title, space, upper(space) AS space_name, author,
              array_to_string(['how-to', 'draft', 'api'][1:n_labels], ',') AS labels, array_to_string(['Up 0', 'Up 1', 'Up 2', 'Up 3'][1:n_ancestors], ',') AS ancestors,
              epoch_ms(created_at) AS created_ms, epoch_ms(date_trunc('second', coalesce(updated_at, created_at))) AS updated_ms FROM v_wiki""",
)
def s24(spark, sf):
    d = wiki.wiki_pages(R.raw_wiki(spark, sf))
    return d.select(
        "id", "type", "title", "space", "space_name", "author", joined("labels").alias("labels"), joined("ancestors").alias("ancestors"),
        ms("created_at").alias("created_ms"), ms("updated_at").alias("updated_ms"),
    )


@query(
    "s25_wiki_comments",
    """SELECT 'confluence_comment_' || page_id || '_0' AS id, CAST(page_id AS STRING) AS parent_id,
              'Comment on ' || title || ' by ' || CASE WHEN page_id % 2 = 0 THEN 'Reader' ELSE 'Unknown' END || ':' || chr(10) || 'See ' || space AS content,
              array_to_string(list_append(['Up 0', 'Up 1', 'Up 2', 'Up 3'][1:n_ancestors], title), '|') AS ancestors
       FROM v_wiki WHERE n_comments > 0""",
)
def s25(spark, sf):
    return wiki.wiki_comments(R.raw_wiki(spark, sf)).select("id", "parent_id", "content", joined("ancestors", "|").alias("ancestors"))


@query(
    "s26_wiki_scope",
    """SELECT 'confluence_' || page_id AS id FROM v_wiki WHERE page_type IN ('page', 'blogpost') AND space LIKE '%example.com'
       AND date_trunc('second', coalesce(updated_at, created_at)) >= TIMESTAMP '2023-10-05 10:20:00'""",
)
def s26(spark, sf):
    pages = wiki.wiki_pages(R.raw_wiki(spark, sf))
    scoped = wiki.wiki_scope(pages, None, "2023-10-05 10:20:45")
    return scoped.filter(c("space").endswith("example.com")).select("id")


@query("s27_drop_repeats", "SELECT DISTINCT url AS id FROM pages WHERE url NOT IN (SELECT url FROM v_wiki WHERE page_type = 'blogpost')")
def s27(spark, sf):
    v = standin(spark, sf, "v_wiki")
    return wiki.drop_repeats(v.select(c("url").alias("id")), v.filter(c("page_type") == "blogpost").select(c("url").alias("id")))


@query(
    "s28_calendar",
    """SELECT meeting_id AS id, coalesce(summary, 'No Title') AS title, location, CASE WHEN all_day THEN epoch_ms(date_trunc('day', start_at)) ELSE epoch_ms(date_trunc('second', start_at)) END AS start_ms,
              array_to_string(list_filter(list_transform(range(0, n_attendees), lambda i: CASE WHEN i <> 1 THEN 'user' || (user_id + i) || '@corp.example' END), lambda x: x IS NOT NULL), ',') AS attendees,
              coalesce(organizer, 'unknown') AS organizer,
              coalesce(summary, '') || ' ' || coalesce(description, '') || ' ' || coalesce(location, '') || ' ' || coalesce(organizer, '') AS search_context,
              '# Event: ' || coalesce(summary, 'No Title') || chr(10) || chr(10) || '**When**: '
                || CASE WHEN all_day THEN strftime(start_at, '%Y-%m-%d') || ' - ' || strftime(end_at, '%Y-%m-%d') ELSE strftime(start_at, '%Y-%m-%d %H:%M:%S') || ' - ' || strftime(end_at, '%Y-%m-%d %H:%M:%S') END
                || coalesce(chr(10) || '**Where**: ' || location, '') || coalesce(chr(10) || '**Organizer**: ' || organizer, '')
                || CASE WHEN n_attendees > 0 THEN chr(10) || '**Attendees**: ' || array_to_string(list_filter(list_transform(range(0, n_attendees), lambda i: CASE WHEN i <> 1 THEN 'user' || (user_id + i) || '@corp.example' END), lambda x: x IS NOT NULL), ', ') ELSE '' END
                || coalesce(chr(10) || chr(10) || '## Description' || chr(10) || description, '') AS content
       FROM v_meetings WHERE status <> 'cancelled'""",
)
def s28(spark, sf):
    d = meetings.calendar(R.raw_calendar(spark, sf))
    return d.select("id", "title", "location", ms("start").alias("start_ms"), joined("attendees").alias("attendees"), "organizer", "search_context", "content")


@query(
    "s29_issue_scope",
    """SELECT issue_key AS id, 'scoped' AS how FROM v_issues WHERE project IN ('BUILDING', 'MACHINERY') AND updated >= TIMESTAMP '1999-03-01 10:30:00'
       UNION ALL SELECT issue_key, 'open' FROM v_issues WHERE updated >= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL '365' DAY""",
)
def s29(spark, sf):
    d = issues.issues(R.raw_issues(spark, sf))
    a = issues.issue_scope(d, ["BUILDING", "MACHINERY"], "1999-03-01 10:30:55").select("id", F.lit("scoped").alias("how"))
    return a.unionByName(issues.issue_scope(d, as_of="2001-08-02 00:00:00").select("id", F.lit("open").alias("how")))


def html_sql(col):
    def steps(out, pairs):
        for pattern, to in pairs:
            p, t = (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in (pattern, to))
            out = f"regexp_replace({out}, '{p}', '{t}', 'g')"
        return out

    out = steps(col, TAG_STEPS)
    for name, char in (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return steps(out, SPACE_STEPS)


@query("s30_html_to_text", f"SELECT page_id, {html_sql('html')} AS text FROM pages")
def s30(spark, sf):
    return spread_small(table(spark, sf, "pages"), "page_id").select("page_id", html_to_text(c("html")).alias("text"))


# Blocks become marks for one, two or three line breaks, a run of marks the longest of them; then the wrap.
LAID_OUT = r"""(SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t5, '&nbsp;', chr(160)), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'),
       '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM (
  SELECT page_id, trim(replace(regexp_replace(regexp_replace(regexp_replace(t4, ' *[\x01\x02\x03\x04 ]*\x03[\x01\x02\x03\x04 ]*', chr(10) || chr(10) || chr(10), 'g'),
         '[\x01\x02\x04 ]*(\x02|\x04[\x01 ]*\x04)[\x01\x02\x04 ]*', chr(10) || chr(10), 'g'), '[\x01\x04 ]*[\x01\x04][\x01\x04 ]*', chr(10), 'g'), chr(5), ' * '), chr(10)) AS t5 FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t2, '(?i)<h([12])\b[^>]*>\s*', chr(3) || '<m\1>', 'g'),
         '(?i)</h[1-6]\s*>|</?(p|ul|ol|table)\b[^>]*>', chr(2), 'g'), '(?i)<br\s*/?>', chr(4), 'g'), '(?i)<li\b[^>]*>\s*', chr(1) || chr(5), 'g'),
         '(?i)</?(li|tr|div|section|article|nav|header|footer|main|aside|body|html)\b[^>]*>', chr(1), 'g'), '<m1>', '# ', 'g'), '<m2>', '## ', 'g') AS t3 FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'),
         '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g'), '\s+', ' ', 'g') AS t2 FROM pages)),
  LATERAL (SELECT regexp_replace(regexp_replace(t3, '<[a-zA-Z/!][^>]*>', '', 'g'), ' +', ' ', 'g') AS t4)))"""


ONE_LINE = r"trim(regexp_replace(body, '\s+', ' ', 'g'))"


def wrapped_sql(col):
    return f"regexp_replace(regexp_replace({col}, '([^\\n]{{1,130}})( +|\\n|\\z)', '\\1' || chr(10), 'g'), '\\s+\\z', '')"


@query("s30_layout", f"SELECT page_id, {wrapped_sql('t')} AS text FROM {LAID_OUT}")
def s30_layout(spark, sf):
    """Whole pages as wrapped text."""
    return spread_small(table(spark, sf, "pages"), "page_id").select("page_id", page_text(c("html")).alias("text"))


@query(
    "s24_layout",
    f"""SELECT 'confluence_' || w.page_id AS id, '# ' || title || chr(10) || chr(10) || '**Space**: ' || upper(space) || ' (' || space || ')' || chr(10)
               || '**Author**: ' || author || chr(10) || chr(10) || {wrapped_sql('t')} AS content
        FROM v_wiki w JOIN {LAID_OUT} l ON w.page_id = l.page_id""",
)
def s24_layout(spark, sf):
    """Pages of the wiki with their HTML laid out."""
    return wiki.wiki_pages(R.raw_wiki(spark, sf), to_text=page_text).select("id", "content")


@query("s15_layout", f"SELECT message_id AS id, CASE WHEN body_kind = 0 THEN body ELSE {wrapped_sql(ONE_LINE)} END AS body FROM v_mail")
def s15_layout(spark, sf):
    """Mail bodies, HTML laid out without heading marks."""
    return mail.with_body(R.raw_mail(spark, sf), lambda html: page_text(html, marks=False)).select("id", "body")


@query(
    "s31_union",
    """SELECT source, type, count(*) AS n FROM (
         SELECT 'jira' AS source, 'issue' AS type FROM v_issues UNION ALL SELECT 'jira', 'comment' FROM c_comments
         UNION ALL SELECT 'slack', CASE WHEN thread_ts IS NULL THEN 'message' ELSE 'thread_reply' END FROM c_msg
         UNION ALL SELECT 'gmail', 'email' FROM c_mail
         UNION ALL SELECT 'drive', CASE WHEN mime_type LIKE '%document%' OR mime_type LIKE '%text%' THEN 'document' WHEN mime_type LIKE '%spreadsheet%' THEN 'spreadsheet'
              WHEN mime_type LIKE '%presentation%' THEN 'presentation' WHEN mime_type = 'application/pdf' THEN 'pdf' ELSE 'other' END FROM v_files
         UNION ALL SELECT 'confluence', page_type FROM v_wiki WHERE page_type <> 'attachment'
         UNION ALL SELECT 'confluence', 'comment' FROM v_wiki WHERE n_comments > 0 AND page_type <> 'attachment'
         UNION ALL SELECT 'calendar', 'event' FROM v_meetings WHERE status <> 'cancelled') GROUP BY ALL""",
)
def s31(spark, sf):
    return documents.all_docs(*R.every_source(spark, sf)).groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s32_markdown",
    """SELECT source, regexp_replace(id, '[^a-zA-Z0-9_-]', '_', 'g') || '.md' AS file_name,
              md5('---' || chr(10) || 'id: "' || id || '"' || coalesce(chr(10) || 'folder: "' || CASE WHEN doc_id % 4 <> 0 THEN folder END || '"', '')
                  || chr(10) || 'refs: ["' || lang || '", "' || folder || '"]' || chr(10) || 'doc_id: ' || doc_id || chr(10) || '---' || chr(10) || chr(10) || '# '
                  || CASE WHEN doc_id % 5 = 0 THEN 'Untitled' ELSE title END || chr(10) || chr(10) || content || chr(10)) AS body_hash
       FROM (SELECT * REPLACE (id || '/' || lang || '.x' AS id) FROM v_docs)""",
)
def s32(spark, sf):
    docs = standin(spark, sf, "v_docs").select(
        F.concat("id", F.lit("/"), "lang", F.lit(".x")).alias("id"), "source", "content", "doc_id",
        F.when(c("doc_id") % 5 != 0, c("title")).alias("title"), F.when(c("doc_id") % 4 != 0, c("folder")).alias("folder"),
        F.array("lang", "folder").alias("refs"),
    )
    path = fresh_path(spark, "markdown")
    documents.write_markdown(docs, path, ["id", "folder", "refs", "doc_id"])
    return spark.read.parquet(path).select("source", "file_name", F.md5("body").alias("body_hash"))

"""Views that give the driver's tables the shape of work-tool records.

Each view is one SELECT that Spark and DuckDB both read.  ``{table}`` names a
given table, ``@ms(t)`` is epoch milliseconds and ``@at(t)`` text of a time;
those two are spelled differently in the two dialects.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from worklore.session import prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DOCS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"
ME = "Customer#000000007"
ME_MAIL = "user7@corp.example"

VIEWS: dict[str, str] = {
    # -- documents and search ------------------------------------------------
    "v_docs": """
        SELECT d.doc_id AS doc_id,
               'doc_' || CAST(d.doc_id AS STRING) AS id,
               CASE d.doc_id % 6 WHEN 0 THEN 'jira' WHEN 1 THEN 'slack' WHEN 2 THEN 'gmail'
                    WHEN 3 THEN 'drive' WHEN 4 THEN 'confluence' ELSE 'calendar' END AS source,
               d.text AS content,
               substring(d.text, 1, 80) AS title,
               d.lang AS lang,
               d.source AS folder,
               'Customer#' || CAST(d.doc_id % 40 AS STRING) AS author,
               coalesce(l.quality, 0) + coalesce(l.toxic, 0) AS label_count,
               l.quality AS quality,
               CASE WHEN d.doc_id % 6 IN (1, 2) THEN NULL
                    ELSE TIMESTAMP '2023-01-01 00:00:00'
                         + INTERVAL '1' HOUR * CAST(d.doc_id % 9000 AS INT) END AS created_at,
               CASE WHEN d.doc_id % 6 IN (1, 2, 3) OR d.doc_id % 35 = 0 THEN NULL
                    ELSE TIMESTAMP '2024-01-30 12:00:00'
                         - INTERVAL '1' HOUR * CAST((d.doc_id * 37) % 9000 AS INT) END AS updated_at,
               CASE WHEN d.doc_id % 6 IN (1, 2, 3)
                    THEN TIMESTAMP '2024-01-29 00:00:00'
                         - INTERVAL '1' HOUR * CAST((d.doc_id * 11) % 5000 AS INT) END AS other_at
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # the six-source document table with the features that ranking reads
    "v_ranked_docs": """
        SELECT v.*,
               CASE WHEN source = 'slack' THEN doc_id % 12 END AS reaction_count,
               CASE WHEN source = 'slack' THEN doc_id % 4 END AS mention_count,
               CASE WHEN source = 'slack' AND doc_id % 5 = 0 THEN 't' || CAST(doc_id AS STRING) END AS thread_ts,
               CASE WHEN source = 'jira' THEN 1 + doc_id % 5 END AS priority_weight,
               CASE WHEN source = 'gmail' THEN doc_id % 6 END AS thread_depth,
               doc_id % 9 = 0 AS is_owner, source = 'calendar' AND doc_id % 5 = 0 AS is_organizer,
               doc_id % 7 = 0 AS is_assigned_to_me,
               CAST(doc_id % 11 AS DOUBLE) / 10 AS relevance_score
        FROM v_docs v""",
    "v_queries": """
        SELECT item_id AS qid, text AS query, CAST(item_id % 10 AS INT) AS topic FROM {benchmark}""",
    # one index row per line of a document: the ready-chunk path
    "v_vectors": """
        SELECT vec_id, 'doc_' || CAST(vec_id AS STRING) AS id, label AS topic, embedding
        FROM {embeddings}""",
    # -- issues --------------------------------------------------------------
    "v_issues": """
        SELECT o.o_orderkey AS n, 'ORD-' || CAST(o.o_orderkey AS STRING) AS issue_key,
               c.c_mktsegment AS project,
               CASE o.o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'In Progress' ELSE 'To Do' END AS status,
               CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
                    WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' END AS priority,
               CASE WHEN o.o_orderkey % 5 <> 0 THEN c.c_name END AS assignee,
               CASE WHEN o.o_orderkey % 11 <> 0 THEN 'Clerk ' || CAST(o.o_custkey % 30 AS STRING) END AS reporter,
               'Order ' || CAST(o.o_orderkey AS STRING) || ' for ' || c.c_name AS summary,
               CASE WHEN o.o_orderkey % 4 <> 0 THEN 'Price ' || CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS STRING) END AS description,
               CAST(o.o_custkey % 4 AS INT) AS n_comments,
               CAST(o.o_orderkey % 3 AS INT) AS n_labels,
               CAST(o.o_orderkey % 4 AS INT) AS n_sprints,
               CAST(o.o_orderkey % 3 AS INT) AS n_links,
               o.o_custkey AS custkey,
               o.o_orderdate AS created,
               o.o_orderdate + INTERVAL '1' DAY * CAST(o.o_custkey % 45 AS INT) AS updated,
               CASE WHEN o.o_orderkey % 6 <> 0 THEN o.o_orderdate + INTERVAL '60' DAY END AS due,
               CAST(5 + o.o_orderkey % 50 AS INT) AS effort_min
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    # -- chat ----------------------------------------------------------------
    "v_users": """
        SELECT 'U' || CAST(c_custkey AS STRING) AS user_id,
               CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS real_name,
               CASE WHEN c_custkey % 5 <> 0 THEN 'cust' || CAST(c_custkey AS STRING) END AS name
        FROM {customer}""",
    "v_channels": """
        SELECT 'C' || CAST(n_nationkey AS STRING) AS channel_id,
               lower(n_name) AS name,
               n_nationkey % 4 <> 3 AS is_member,
               n_nationkey % 5 = 0 AS is_im,
               n_nationkey % 6 = 1 AS is_mpim,
               n_nationkey % 3 = 2 AS is_private,
               CASE WHEN n_nationkey % 5 = 0 THEN 'U' || CAST(n_nationkey * 70 AS STRING) END AS user_id
        FROM {nation}""",
    "v_messages": """
        SELECT conv_id, turn,
               'C' || CAST(conv_id % 25 AS STRING) AS channel_id,
               CAST(1704067200 + conv_id * 3600 + turn * 60 AS STRING) || '.000100' AS ts,
               CASE WHEN turn > 0 THEN CAST(1704067200 + conv_id * 3600 AS STRING) || '.000100' END AS thread_ts,
               CASE WHEN turn = 0 THEN 3 ELSE 0 END AS reply_count,
               CASE WHEN role <> 'system' THEN 'U' || CAST((conv_id * 7 + turn * 13) % 200 AS STRING) END AS user_id,
               CASE WHEN role = 'system' AND conv_id % 2 = 1 THEN 'bot_message' END AS subtype,
               role,
               text || CASE WHEN (conv_id + turn) % 3 = 0
                            THEN ' <@U' || CAST(conv_id % 40 AS STRING) || '> and <@U9' || CAST(turn AS STRING) || '|bob>'
                            ELSE '' END
                    || CASE WHEN (conv_id + turn) % 4 = 0 THEN ' can you check?' ELSE '' END AS text,
               CAST((conv_id + turn) % 5 AS INT) AS n_reactions
        FROM {conversations}""",
    # -- mail ----------------------------------------------------------------
    "v_mail": """
        SELECT conv_id, turn,
               'm' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS message_id,
               't' || CAST(conv_id AS STRING) AS thread_id,
               CASE WHEN conv_id % 17 = 0 THEN '' ELSE
                    'user' || CAST((conv_id + turn) % 12 AS STRING) || '@'
                    || CASE (conv_id + turn) % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'Corp.example'
                            WHEN 2 THEN 'Yahoo.com' ELSE 'corp.example' END END AS sender,
               'user' || CAST(turn AS STRING) || '@corp.example, ,user7@corp.example'
                    || CASE WHEN conv_id % 3 = 0 THEN ',  a@x.io , b@x.io' ELSE '' END AS to_line,
               CASE WHEN conv_id % 4 = 0 THEN 'boss@corp.example' WHEN conv_id % 4 = 1 THEN '' END AS cc_line,
               CASE WHEN turn % 4 = 3 THEN '' ELSE
                    CASE WHEN conv_id % 9 = 0 THEN 'Urgent: ' ELSE 'Re: ' END || substring(text, 1, 30) END AS subject,
               CASE WHEN turn % 5 = 4 THEN 'INBOX' WHEN turn % 5 = 2 THEN 'INBOX,IMPORTANT' ELSE 'WORK' END AS labels,
               CASE WHEN conv_id % 13 = 0 AND turn % 4 = 3 THEN '' ELSE text END AS body,
               CAST(conv_id % 3 AS INT) AS body_kind,
               TIMESTAMP '2024-01-28 00:00:00' - INTERVAL '1' HOUR * CAST(conv_id % 700 AS INT)
                    + INTERVAL '1' MINUTE * CAST(turn * 7 AS INT) AS sent_at
        FROM {conversations}""",
    # -- files ---------------------------------------------------------------
    "v_folders": """
        SELECT 'r' || CAST(r_regionkey AS STRING) AS folder_id, r_name AS name, CAST(NULL AS STRING) AS parent_id FROM {region}
        UNION ALL
        SELECT 'n' || CAST(n_nationkey AS STRING), n_name, 'r' || CAST(n_regionkey AS STRING) FROM {nation}
        UNION ALL
        SELECT 's' || CAST(s_suppkey AS STRING), s_name,
               CASE WHEN s_suppkey % 50 = 3 THEN 's' || CAST(s_suppkey + 1 AS STRING)
                    WHEN s_suppkey % 50 = 4 THEN 's' || CAST(s_suppkey - 1 AS STRING)
                    ELSE 'n' || CAST(s_nationkey AS STRING) END FROM {supplier}""",
    "v_files": """
        SELECT p_partkey AS n, 'f' || CAST(p_partkey AS STRING) AS file_id,
               p_name || CASE p_size % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.md' WHEN 3 THEN '.kt'
                              WHEN 4 THEN '' WHEN 5 THEN '.tar.gz' WHEN 6 THEN '.html' ELSE '.docx' END AS name,
               CASE p_size % 9 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/png'
                    WHEN 3 THEN 'application/vnd.google-apps.spreadsheet' WHEN 4 THEN 'application/vnd.google-apps.presentation'
                    WHEN 5 THEN 'application/zip' WHEN 6 THEN 'application/vnd.google-apps.folder'
                    WHEN 7 THEN 'application/json' ELSE 'application/vnd.google-apps.document' END AS mime_type,
               CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE 's' || CAST(p_partkey % 12 AS STRING) END AS parent_id,
               CASE WHEN p_partkey % 6 <> 0 THEN 'Owner ' || CAST(p_partkey % 20 AS STRING) END AS owner,
               p_partkey % 13 = 0 AS trashed,
               p_partkey % 6 = 1 AS owned_by_me,
               p_partkey % 7 = 1 AS shared_with_me,
               p_partkey % 8 = 1 AS starred,
               TIMESTAMP '2023-06-01 00:00:00' + INTERVAL '1' HOUR * CAST(p_partkey % 5000 AS INT) AS created_at,
               TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '1' HOUR * CAST((p_partkey * 7) % 4000 AS INT) AS modified_at,
               CASE WHEN p_partkey % 15 = 0 THEN '<HTML><body>' || p_name || '</body></HTML>'
                    WHEN p_partkey % 16 = 0 THEN p_name || chr(0) || p_brand
                    ELSE p_name || ' ' || p_brand || ' ' || p_type END AS body
        FROM {part}""",
    # -- wiki ----------------------------------------------------------------
    "v_wiki": """
        SELECT page_id, html, url,
               CASE WHEN page_id % 9 = 8 THEN 'attachment' WHEN page_id % 9 = 4 THEN 'blogpost' ELSE 'page' END AS page_type,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               regexp_extract(url, '://([^/]+)', 1) AS space,
               'Author ' || CAST(page_id % 15 AS STRING) AS author,
               CAST(page_id % 4 AS INT) AS n_labels,
               CAST(page_id % 5 AS INT) AS n_ancestors,
               CAST(page_id % 3 AS INT) AS n_comments,
               TIMESTAMP '2023-03-01 00:00:30' + INTERVAL '1' HOUR * CAST(page_id % 7000 AS INT) AS created_at,
               CASE WHEN page_id % 4 <> 0 THEN TIMESTAMP '2024-01-30 10:20:30'
                    - INTERVAL '1' MINUTE * CAST((page_id * 991) % 200000 AS INT) END AS updated_at
        FROM {pages}""",
    # -- meetings and runs ---------------------------------------------------
    # times to the millisecond, as the work tools give them
    "v_events": """
        SELECT event_id, date_trunc('millisecond', ts) AS ts, user_id, event_type, value, props FROM {events}""",
    "v_meetings": """
        SELECT event_id, 'ev' || CAST(event_id AS STRING) AS meeting_id,
               CASE WHEN event_id % 10 <> 3 THEN 'Meeting ' || event_type END AS summary,
               CASE WHEN event_id % 4 = 0 THEN 'Deadline for ' || event_type END AS description,
               CASE WHEN event_id % 3 = 0 THEN 'Room ' || CAST(user_id % 9 AS STRING) END AS location,
               CASE WHEN event_id % 20 = 7 THEN 'cancelled' ELSE 'confirmed' END AS status,
               CASE WHEN event_id % 25 <> 6 THEN 'user' || CAST(user_id AS STRING) || '@corp.example' END AS organizer,
               user_id,
               CAST(event_id % 8 AS INT) AS n_attendees,
               event_id % 6 = 5 AS all_day,
               ts AS start_at,
               ts + INTERVAL '1' MINUTE * CAST(15 + CAST(floor(value) AS INT) % 60 AS INT) AS end_at,
               ts - INTERVAL '1' DAY * CAST(event_id % 20 AS INT) AS created_at,
               CASE WHEN event_id % 5 <> 0 THEN ts - INTERVAL '1' HOUR * CAST(event_id % 50 AS INT) END AS updated_at
        FROM v_events""",
    "v_runs": """
        SELECT event_id AS seq,
               CASE event_type WHEN 'click' THEN 'jira' WHEN 'view' THEN 'slack' WHEN 'purchase' THEN 'gmail'
                    WHEN 'signup' THEN 'drive' ELSE 'confluence' END AS source,
               event_type || '_' || CAST(event_id AS STRING) AS run_id,
               ts AS started_at, @ms(ts) AS started_ms,
               CASE WHEN event_id % 50 = 11 THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS duration_ms,
               CASE WHEN event_id % 9 = 0 THEN 'error' WHEN event_id % 10 = 1 THEN 'running' ELSE 'completed' END AS status,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS docs
        FROM v_events""",
    # -- projects and proposals ---------------------------------------------
    "v_projects": """
        SELECT 'P' || CAST(c_custkey AS STRING) AS project_id, c_name AS title,
               CASE WHEN c_custkey % 4 <> 0 THEN 'Account in nation ' || CAST(c_nationkey AS STRING) END AS description,
               CASE c_custkey % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'paused' ELSE 'active' END AS status,
               CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'informed' ELSE 'muted' END AS my_role,
               c_mktsegment AS segment,
               c_custkey AS custkey,
               TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 9000 AS INT) AS updated_at
        FROM {customer}""",
    "v_proposals": """
        SELECT o_orderkey AS seq, 'R' || CAST(o_orderkey AS STRING) AS proposal_id,
               's' || CAST(o_custkey % 8 AS STRING) AS session_id,
               CASE WHEN o_orderkey % 10 <> 0 THEN 'P' || CAST(o_custkey AS STRING) END AS project_id,
               CASE o_orderkey % 9 WHEN 0 THEN 'title' WHEN 1 THEN 'description' WHEN 2 THEN 'goals'
                    WHEN 3 THEN 'status' WHEN 4 THEN 'myRole' WHEN 5 THEN 'participants'
                    WHEN 6 THEN 'sources' WHEN 7 THEN 'tags' ELSE 'metadata' END AS field,
               '"v' || CAST(o_orderkey AS STRING) || '"' AS new_value,
               CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'edited' END AS status,
               o_orderdate AS created_at
        FROM {orders}""",
    # -- ledger, tasks -------------------------------------------------------
    "v_ledger_raw": """
        SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-'
                   || CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) AS row_id,
               CASE s.s_suppkey % 20 WHEN 1 THEN 'Netflix' WHEN 2 THEN 'Spotify' WHEN 3 THEN 'Rent'
                    WHEN 4 THEN 'Internet' ELSE s.s_name END AS merchant,
               CASE WHEN l.l_orderkey % 10 = 9 THEN NULL
                    ELSE CAST(l.l_quantity * 29.9 AS DECIMAL(18, 2)) END AS original_amount,
               CASE WHEN l.l_linenumber = 7 OR l.l_orderkey % 10 = 9 THEN NULL
                    ELSE CAST(l.l_quantity * 29.9 + CAST(l.l_linenumber % 2 AS DOUBLE) AS DECIMAL(18, 2)) END AS actual_amount,
               l.l_shipdate AS purchased_at,
               CASE WHEN l.l_shipdate > TIMESTAMP '2001-07-05 00:00:00' THEN NULL
                    ELSE l.l_shipdate + INTERVAL '3' DAY END AS paid_at,
               p.p_brand AS category
        FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
        JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "v_ledger": """
        SELECT row_id, merchant, coalesce(actual_amount, original_amount) AS amount,
               purchased_at, paid_at, category
        FROM v_ledger_raw WHERE coalesce(actual_amount, original_amount) IS NOT NULL""",
    "v_tasks": """
        SELECT o_orderkey AS task_id, 'Ship order ' || CAST(o_orderkey AS STRING) AS content,
               o_orderdate + INTERVAL '1' MINUTE * CAST((o_orderkey * 17) % 1440 AS INT) AS execute_at,
               o_orderstatus = 'F' AS executed,
               CASE o_orderkey % 6 WHEN 0 THEN '0 7 * * *' WHEN 1 THEN '30 7 * * 1-5' WHEN 2 THEN '0 8 * * 0,6'
                    WHEN 3 THEN '0 13 15 * *' WHEN 4 THEN '*/30 9-10 * * 7' END AS recurrence,
               CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2001-08-05 12:00:00' END AS recurrence_end
        FROM {orders}""",
}

# Check-only views: results of an operation spelled in DuckDB SQL, for the
# checks of the operations that follow it.
CHECK_VIEWS: dict[str, str] = {}

_NAME = re.compile(r"\b[cv]_[a-z_]+\b")


@lru_cache(maxsize=None)
def _needed(sql: str) -> tuple[str, ...]:
    """Views a text reads, each after the ones it is built from."""
    order: list[str] = []
    for name in _NAME.findall(sql):
        body = VIEWS.get(name) or CHECK_VIEWS.get(name)
        if body:
            for dep in (*_needed(re.sub(rf"\b{name}\b", "", body)), name):
                if dep not in order:
                    order.append(dep)
    return tuple(order)


def _ctes(names, spark_path: str | None) -> str:
    parts = []
    for name in names:
        body = VIEWS[name] if name in VIEWS else CHECK_VIEWS[name]
        if spark_path is None:
            tables = {t: t for t in TABLES}
            ms, at = r"epoch_ms(\1)", r"strftime(\1, '%Y-%m-%d %H:%M:%S')"
        else:
            tables = {t: f"parquet.`{spark_path}/{t}.parquet`" for t in TABLES}
            ms, at = r"unix_millis(CAST(\1 AS TIMESTAMP))", r"date_format(\1, 'yyyy-MM-dd HH:mm:ss')"
        for table, target in tables.items():
            body = body.replace("{" + table + "}", target)
        body = re.sub(r"@ms\(([^()]*)\)", ms, body)
        body = re.sub(r"@at\(([^()]*)\)", at, body)
        parts.append(f"{name} AS ({body})" if not body.lstrip().startswith("+") else body.lstrip()[1:])
    return ",\n".join(parts)


def with_views(sql: str) -> str:
    """DuckDB text: the views a check names, then the check itself."""
    names = _needed(sql)
    if not names:
        return sql
    head, body = _ctes(names, None), sql.strip()
    for lead in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(lead):
            return f"WITH RECURSIVE {head},\n{body[len(lead):]}"
    return f"WITH RECURSIVE {head}\n{body}"


#: Labels (some 20 bytes each) up to which they go to the documents; beyond that the texts are shuffled to them.
BROADCAST_LABELS = 4_000_000


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view as a DataFrame over the tables in ``sf_dir``."""
    prepare(spark)
    names = _needed(name)
    views = _ctes(names, sf_dir.rstrip("/"))
    if "v_docs" in names and table(spark, sf_dir, "labels").count() <= BROADCAST_LABELS:
        views = views.replace("SELECT d.doc_id AS doc_id,", "SELECT /*+ BROADCAST(l) */ d.doc_id AS doc_id,", 1)
    return spark.sql(f"WITH {views} SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

"""Landed raw tables: one declared schema per work tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAMED = "STRUCT<name: STRING>"
_PERSON = "STRUCT<displayName: STRING>"

SCHEMAS: dict[str, str] = {
    "jira": f"""key STRING,
        fields STRUCT<summary: STRING, description: STRING, issuetype: {_NAMED}, status: {_NAMED}, priority: {_NAMED},
          assignee: {_PERSON}, reporter: {_PERSON}, labels: ARRAY<STRING>, components: ARRAY<{_NAMED}>,
          project: STRUCT<key: STRING>, created: STRING, updated: STRING, sprint: ARRAY<{_NAMED}>,
          issuelinks: ARRAY<STRUCT<type: {_NAMED}, inwardIssue: STRUCT<key: STRING>, outwardIssue: STRUCT<key: STRING>>>,
          comment: STRUCT<comments: ARRAY<STRUCT<id: STRING, body: STRING, author: {_PERSON}, created: STRING, updated: STRING>>>>,
        renderedFields STRUCT<description: STRING, comment: STRUCT<comments: ARRAY<STRUCT<body: STRING>>>>""",
    "slack": """channel_id STRING, ts STRING, user STRING, subtype STRING, text STRING, thread_ts STRING, reply_count INT,
        reactions ARRAY<STRUCT<name: STRING, count: INT>>, files ARRAY<STRUCT<id: STRING>>""",
    # The part tree can be of any depth: it stays JSON text.
    "gmail": """id STRING, threadId STRING, labelIds ARRAY<STRING>,
        payload STRUCT<mimeType: STRING, headers: ARRAY<STRUCT<name: STRING, value: STRING>>, body: STRUCT<data: STRING>,
          parts: STRING>""",
    "drive": """id STRING, name STRING, mimeType STRING, parents ARRAY<STRING>,
        owners ARRAY<STRUCT<displayName: STRING, emailAddress: STRING>>, createdTime STRING, modifiedTime STRING,
        webViewLink STRING, body STRING""",
    "confluence": f"""id STRING, type STRING, title STRING, space STRUCT<key: STRING, name: STRING>,
        history STRUCT<createdBy: {_PERSON}, createdDate: STRING, lastUpdated: STRUCT<when: STRING>>,
        ancestors ARRAY<STRUCT<title: STRING>>, labels ARRAY<{_NAMED}>, body STRING, webui STRING,
        comments ARRAY<STRUCT<id: STRING, body: STRING, author: STRING, created: STRING, updated: STRING>>""",
    "calendar": """id STRING, summary STRING, description STRING, location STRING, status STRING,
        start STRUCT<dateTime: STRING, date: STRING>, end STRUCT<dateTime: STRING, date: STRING>,
        attendees ARRAY<STRUCT<email: STRING>>, organizer STRUCT<email: STRING>, htmlLink STRING, created STRING, updated STRING""",
}
CORRUPT = "_corrupt_record"


def read_raw(spark: SparkSession, path: str, source: str, fmt: str = "json") -> DataFrame:
    """Raw records of one tool; a record that does not parse is kept as text."""
    schema = SCHEMAS[source]
    if fmt == "json":
        return spark.read.schema(f"{schema}, {CORRUPT} STRING").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return spark.read.schema(schema).format(fmt).load(path)

"""Issue tracker records to documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.functions.html import html_to_text
from worklore.functions.text import first_set
from worklore.session import spread_small


def sprint(arr: Column) -> Column:
    """Name of the last, usually the running, sprint."""
    return F.try_element_at(arr, F.lit(-1))["name"]


def links(arr: Column) -> Column:
    """(type, key, direction) of linked issues; inward wins, links to nothing go."""
    kept = F.filter(arr, lambda x: x["inwardIssue"]["key"].isNotNull() | x["outwardIssue"]["key"].isNotNull())
    edges = F.transform(
        kept,
        lambda x: F.struct(
            x["type"]["name"].alias("type"),
            F.coalesce(x["inwardIssue"]["key"], x["outwardIssue"]["key"]).alias("key"),
            F.when(x["inwardIssue"]["key"].isNotNull(), "inward").otherwise("outward").alias("direction"),
        ),
    )
    return F.coalesce(edges, F.array().cast("array<struct<type:string,key:string,direction:string>>"))


def issue_content(raw: DataFrame, to_text: Callable[[Column], Column] = html_to_text) -> Column:
    f = raw["fields"]

    def bullet(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- **{label}**: "), value)

    rendered = F.when(raw["renderedFields.description"] != "", to_text(raw["renderedFields.description"]))
    description = first_set(F.coalesce(rendered, f["description"]))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# ["), raw["key"], F.lit("] "), f["summary"]),
        F.lit(""),
        F.lit("## Metadata"),
        bullet("Type", f["issuetype"]["name"]),
        bullet("Status", f["status"]["name"]),
        bullet("Priority", F.coalesce(f["priority"]["name"], F.lit("None"))),
        bullet("Project", f["project"]["key"]),
        bullet("Assignee", f["assignee"]["displayName"]),
        bullet("Reporter", f["reporter"]["displayName"]),
        F.when(F.size(f["labels"]) > 0, bullet("Labels", F.array_join(f["labels"], ", "))),
        F.concat(F.lit("\n## Description\n"), description),
    )


def issues(raw: DataFrame, base_url: str = "", to_text: Callable[[Column], Column] = html_to_text) -> DataFrame:
    raw = spread_small(raw, "key")
    f = raw["fields"]
    edges = links(f["issuelinks"])
    return raw.select(
        F.col("key").alias("id"),
        F.lit("jira").alias("source"),
        F.lit("issue").alias("type"),
        f["summary"].alias("title"),
        issue_content(raw, to_text).alias("content"),
        f["project"]["key"].alias("project"),
        f["issuetype"]["name"].alias("issue_type"),
        f["status"]["name"].alias("status"),
        first_set(f["priority"]["name"], F.lit("None")).alias("priority"),
        f["assignee"]["displayName"].alias("assignee"),
        first_set(f["reporter"]["displayName"], F.lit("Unknown")).alias("reporter"),
        f["labels"].alias("labels"),
        F.transform(f["components"], lambda c: c["name"]).alias("components"),
        sprint(f["sprint"]).alias("sprint"),
        F.to_json(edges).alias("linked_issues"),
        F.try_to_timestamp(f["created"]).alias("created_at"),
        F.try_to_timestamp(f["updated"]).alias("updated_at"),
        F.concat(F.lit(f"{base_url}/browse/"), "key").alias("url"),
    )


def link_edges(raw: DataFrame) -> DataFrame:
    """The links as an edge table."""
    return raw.select(F.col("key").alias("from_key"), F.inline(links(raw["fields.issuelinks"])))


def issue_comments(raw: DataFrame, base_url: str = "", to_text: Callable[[Column], Column] = html_to_text) -> DataFrame:
    """Each comment as its own document under its issue."""
    raw = spread_small(raw, "key")
    rows = raw.select(
        "key", raw["fields.project.key"].alias("project"), raw["renderedFields.comment.comments"].alias("_r"),
        F.posexplode("fields.comment.comments").alias("_i", "c"),
    )
    rendered = F.get(F.col("_r"), F.col("_i"))
    body = F.when(rendered.isNotNull(), F.coalesce(to_text(rendered["body"]), F.lit(""))).otherwise(
        F.coalesce(F.col("c.body"), F.lit("JSON content"))
    )
    title = F.concat(F.lit("Comment on "), "key", F.lit(" by "), F.col("c.author.displayName"))
    return rows.select(
        F.concat("key", F.lit("_comment_"), "c.id").alias("id"),
        F.lit("jira").alias("source"),
        F.lit("comment").alias("type"),
        title.alias("title"),
        F.concat(title, F.lit(":\n"), body).alias("content"),
        F.col("key").alias("parent_id"),
        "project",
        F.col("c.author.displayName").alias("reporter"),
        F.try_to_timestamp("c.created").alias("created_at"),
        F.try_to_timestamp("c.updated").alias("updated_at"),
        F.concat(F.lit(f"{base_url}/browse/"), "key", F.lit("?focusedCommentId="), "c.id").alias("url"),
    )


def issue_scope(df: DataFrame, projects=None, since: str | None = None, as_of: str | None = None) -> DataFrame:
    """Projects AND changed since, to the minute; with neither, the last year."""
    if projects:
        df = df.filter(F.col("project").isin(list(projects)))
    if since:
        df = df.filter(F.col("updated_at") >= F.date_trunc("minute", F.lit(since).cast("timestamp")))
    if not projects and not since:
        df = df.filter(F.col("updated_at") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL '365' DAY"))
    return df

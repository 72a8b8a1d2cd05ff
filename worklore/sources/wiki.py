"""Wiki records to documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklore.functions.html import html_to_text
from worklore.functions.text import blank, first_set
from worklore.session import spread_small

PAGE_TYPES = ["page", "blogpost"]


def _strings(col):
    return F.coalesce(col, F.array().cast("array<string>"))


def wiki_pages(raw: DataFrame, base_url: str = "", to_text: Callable[[Column], Column] = html_to_text) -> DataFrame:
    """Pages to documents; ``to_text`` turns their HTML into text, flat or laid out (`markup.page_text`)."""
    raw = spread_small(raw, "id")
    h = raw["history"]
    author = h["createdBy"]["displayName"]
    content = F.concat(
        F.lit("# "), "title", F.lit("\n\n**Space**: "), raw["space.name"], F.lit(" ("), raw["space.key"],
        F.lit(")\n**Author**: "), author, F.lit("\n\n"), to_text(F.coalesce("body", F.lit(""))),
    )
    return raw.select(
        F.concat(F.lit("confluence_"), "id").alias("id"),
        F.lit("confluence").alias("source"),
        "type",
        "title",
        content.alias("content"),
        raw["space.key"].alias("space"),
        raw["space.name"].alias("space_name"),
        author.alias("author"),
        _strings(F.transform("labels", lambda x: x["name"])).alias("labels"),
        _strings(F.transform("ancestors", lambda a: a["title"])).alias("ancestors"),
        F.try_to_timestamp(h["createdDate"]).alias("created_at"),
        F.try_to_timestamp(first_set(h["lastUpdated"]["when"], h["createdDate"])).alias("updated_at"),
        F.concat(F.lit(f"{base_url}/wiki"), "webui").alias("url"),
    )


def wiki_comments(raw: DataFrame, base_url: str = "", to_text: Callable[[Column], Column] = html_to_text) -> DataFrame:
    """Comments that say something, under their page."""
    rows = raw.select(
        "id", "title", "space", "webui", _strings(F.transform("ancestors", lambda a: a["title"])).alias("_up"),
        F.explode("comments").alias("c"),
    ).withColumn("_text", to_text(F.coalesce("c.body", F.lit("")))).filter(~blank(F.col("_text")))
    author = first_set(F.col("c.author"), F.lit("Unknown"))
    return rows.select(
        F.concat(F.lit("confluence_comment_"), "c.id").alias("id"),
        F.lit("confluence").alias("source"),
        F.lit("comment").alias("type"),
        F.concat(F.lit("Comment on "), "title").alias("title"),
        F.concat(F.lit("Comment on "), "title", F.lit(" by "), author, F.lit(":\n"), "_text").alias("content"),
        F.col("id").alias("parent_id"),
        F.col("space.key").alias("space"),
        F.col("space.name").alias("space_name"),
        author.alias("author"),
        F.array().cast("array<string>").alias("labels"),
        F.array_append("_up", F.col("title")).alias("ancestors"),
        F.try_to_timestamp("c.created").alias("created_at"),
        F.try_to_timestamp(first_set(F.col("c.updated"), F.col("c.created"))).alias("updated_at"),
        F.concat(F.lit(f"{base_url}/wiki"), "webui", F.lit("?focusedCommentId="), "c.id", F.lit("#comment-"), "c.id").alias("url"),
    )


def wiki_scope(df: DataFrame, spaces=None, since: str | None = None) -> DataFrame:
    """Pages and posts, of the given spaces, changed since, to the minute."""
    df = df.filter(F.col("type").isin(PAGE_TYPES))
    if spaces:
        df = df.filter(F.col("space").isin(list(spaces)))
    if since:
        df = df.filter(F.col("updated_at") >= F.date_trunc("minute", F.lit(since).cast("timestamp")))
    return df


def drop_repeats(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Pages not seen in this run yet, each once."""
    return df.dropDuplicates(["id"]).join(seen.select("id"), "id", "left_anti")

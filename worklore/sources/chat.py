"""Chat records to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.functions.text import first_set
from worklore.operators.joins import left_join_where

MENTION = r"<@([A-Z0-9]+)(?:\|[^>]*)?>"
PREVIEW_CHARS = 80


def mentions(text: Column) -> Column:
    """Ids in ``<@ID>`` or ``<@ID|name>``, in order."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))


def reactions(arr: Column) -> tuple[Column, Column]:
    """Total count, and the names of the three most used."""
    total = F.coalesce(F.aggregate(arr, F.lit(0), lambda acc, r: acc + r["count"]), F.lit(0))
    ranked = F.array_sort(
        F.transform(arr, lambda r, i: F.struct((-r["count"]).alias("n"), i.alias("i"), r["name"].alias("name")))
    )
    return total, F.coalesce(F.transform(F.slice(ranked, 1, 3), lambda r: r["name"]), F.array().cast("array<string>"))


def display_names(users: DataFrame) -> DataFrame:
    return users.select("user_id", first_set(F.col("real_name"), F.col("name")).alias("shown"))


def resolve_mentions(msgs: DataFrame, users: DataFrame, key: list[str]) -> DataFrame:
    """``formatted`` text with names for ids, and ``mentioned_users``.

    Only messages that mention someone are exploded; ids nobody has stay ids.
    """
    keyed = msgs.withColumn("_ids", mentions(F.col("text")))
    pairs = keyed.filter(F.size("_ids") > 0).select(*key, F.posexplode("_ids").alias("_i", "_id"))
    named = pairs.join(display_names(users).withColumnRenamed("user_id", "_id"), "_id", "left")
    lists = named.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_id", F.coalesce("shown", "_id").alias("shown")))).alias("_names")
    )
    out = left_join_where(keyed, lists, key, F.size("_ids") > 0)

    def swap(acc: Column, n: Column) -> Column:
        pattern = F.concat(F.lit("<@"), n["_id"], F.lit(r"(\|[^>]*)?>"))
        return F.call_function("array_join", F.split(acc, pattern, -1), F.concat(F.lit("@"), n["shown"]))

    text = F.when(F.col("_names").isNotNull(), F.aggregate("_names", F.col("text"), swap)).otherwise(F.col("text"))
    return out.withColumn("formatted", text).withColumn(
        "mentioned_users",
        F.coalesce(F.transform("_names", lambda n: n["shown"]), F.array().cast("array<string>")),
    ).drop("_ids", "_names")


def epoch_ts(ts: Column) -> Column:
    """Epoch seconds with a fraction, as text, to a time."""
    return F.timestamp_micros((ts.cast("decimal(20,6)") * 1000000).cast("bigint"))


def _documents(rows: DataFrame, users: DataFrame, team: str, kind: Column, parent: Column, head: str, context: Column) -> DataFrame:
    authors = display_names(users).withColumnRenamed("user_id", "user").withColumnRenamed("shown", "_author")
    named = resolve_mentions(rows, users, ["channel_id", "ts"]).join(authors, "user", "left")
    author = F.coalesce("_author", first_set(F.col("user")), F.lit("Bot"))
    total, top = reactions(F.col("reactions"))
    when = epoch_ts(F.col("ts"))
    preview = F.trim(F.substring(F.regexp_replace("formatted", r"\n+", " "), 1, PREVIEW_CHARS))
    return named.select(
        F.concat(F.lit("slack_"), "channel_id", F.lit("_"), "ts").alias("id"),
        F.lit("slack").alias("source"),
        kind.alias("type"),
        F.concat(F.lit("#"), "channel", F.lit(": "), preview).alias("title"),
        F.concat(
            F.lit(f"### {head} in #"), "channel", F.lit("\n**Author**: "), author, F.lit("\n**Time**: "),
            F.date_format(when, "yyyy-MM-dd HH:mm:ss"), context, F.lit("\n\n"), "formatted",
        ).alias("content"),
        parent.alias("parent_id"),
        "channel",
        "channel_id",
        author.alias("author"),
        F.coalesce("user", F.lit("")).alias("author_id"),
        "thread_ts",
        when.alias("timestamp"),
        (F.size(F.coalesce("files", F.array().cast("array<struct<id:string>>"))) > 0).alias("has_attachments"),
        "mentioned_users",
        total.alias("reaction_count"),
        top.alias("top_reactions"),
        (F.coalesce("subtype", F.lit("")) == "bot_message").alias("is_bot"),
        F.concat(F.lit(f"https://app.slack.com/client/{team}/"), "channel_id", F.lit("/p"), F.regexp_replace("ts", r"\.", "")).alias("url"),
    )


def _by_people(raw: DataFrame) -> DataFrame:
    return raw.filter((F.coalesce("user", F.lit("")) != "") | (F.col("subtype") == "bot_message"))


def messages(raw: DataFrame, users: DataFrame, channel_table: DataFrame, team: str = "") -> DataFrame:
    """Channel history to documents; rows by nobody (system rows) are dropped."""
    rows = _by_people(raw).join(channel_table.select("channel_id", F.col("name").alias("channel")), "channel_id")
    lone = F.col("thread_ts").isNull() | (F.col("thread_ts") == F.col("ts"))
    kind = F.when(lone, "message").otherwise("thread_reply")
    return _documents(rows, users, team, kind, F.lit(None).cast("string"), "Message", F.lit(""))


def thread_replies(starters: DataFrame, replies: DataFrame, users: DataFrame, channel_table: DataFrame, team: str = "") -> DataFrame:
    """Replies joined to the message that opened the thread, without that message."""
    opened = starters.filter((F.col("reply_count") > 0) & F.col("thread_ts").isNull()).select(
        "channel_id", F.col("ts").alias("thread_ts")
    )
    rows = (
        _by_people(replies)
        .join(opened, ["channel_id", "thread_ts"])
        .filter(F.col("ts") != F.col("thread_ts"))
        .join(channel_table.select("channel_id", F.col("name").alias("channel")), "channel_id")
    )
    parent = F.concat(F.lit("slack_"), "channel_id", F.lit("_"), "thread_ts")
    context = F.concat(F.lit("\n**Context**: Reply to message "), "thread_ts")
    return _documents(rows, users, team, F.lit("thread_reply"), parent, "Thread Reply", context)


def channels(raw: DataFrame, users: DataFrame, ids=None) -> DataFrame:
    """Channels the reader is in, and direct messages named after the other side."""
    named = raw.join(display_names(users), "user_id", "left").withColumn(
        "name",
        F.when(
            F.col("is_im") & F.col("user_id").isNotNull(),
            F.coalesce("shown", F.concat(F.lit("DM with "), "user_id")),
        ).otherwise(F.col("name")),
    )
    out = named.filter(F.col("is_member") | F.col("is_im")).drop("shown")
    return out.filter(F.col("channel_id").isin(list(ids))) if ids else out


def channel_kind() -> Column:
    return (
        F.when(F.col("is_im"), "dm").when(F.col("is_mpim"), "mpim").when(F.col("is_private"), "private").otherwise("public")
    )

"""Mail records to documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.functions.html import html_to_text
from worklore.functions.text import blank, first_set, trim_all
from worklore.session import spread_small


def header(headers: Column, name: str) -> Column:
    """Value of a header, whatever the case of its name; empty if not there."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def addresses(line: Column) -> Column:
    parts = F.transform(F.split(line, ","), trim_all)
    return F.filter(parts, lambda a: a != "")


def decoded(data: Column) -> Column:
    return F.unbase64(F.translate(data, "-_", "+/")).cast("string")


#: One level of the part tree; what is inside a part stays JSON text until it is opened.
PARTS = "array<struct<mimeType: string, body: struct<data: string>, parts: string>>"
# Zone names of mail dates.
ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def with_parts(df: DataFrame, column: str = "payload.parts") -> DataFrame:
    """The part tree, JSON text, as a list ``parts_list``: each part before those inside it.

    Opened level by level inside the row, whatever the depth: a level needs a
    brace, so a row has at most as many steps as its text has braces, and steps
    with no closed part left do nothing.
    """

    def opened(p: Column) -> Column:
        own = F.array(F.struct(p["mimeType"].alias("mimeType"), p["body"].alias("body"), F.lit(None).cast("string").alias("parts")))
        children = F.coalesce(F.from_json(p["parts"], PARTS), F.filter(own, lambda _: F.lit(False)))
        return F.when(p["parts"].isNull(), own).otherwise(F.concat(own, children))

    def level(found: Column, _: Column) -> Column:
        return F.when(F.exists(found, lambda p: p["parts"].isNotNull()), F.flatten(F.transform(found, opened))).otherwise(found)

    text = F.col(column)
    steps = F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit("{"))))
    return df.withColumn("parts_list", F.aggregate(steps, F.from_json(text, PARTS), level))


def with_body(df: DataFrame, to_text: Callable[[Column], Column] = html_to_text) -> DataFrame:
    """Adds ``body``: the first plain part, else the first HTML part as text."""
    payload = F.col("payload")

    def first(kind: str) -> Column:
        nested = F.filter("parts_list", lambda p: (p["mimeType"] == kind) & (p["body"]["data"] != ""))
        alone = F.when((payload["mimeType"] == kind) & (payload["body"]["data"] != ""), payload["body"]["data"])
        return decoded(F.when(payload["parts"].isNotNull(), F.get(nested, F.lit(0))["body"]["data"]).otherwise(alone))

    return with_parts(df).withColumn("body", F.coalesce(first("text/plain"), to_text(first("text/html")), F.lit(""))).drop("parts_list")


def mail_date(line: Column) -> Column:
    """Time of a date header: with or without weekday, seconds, zone name or a comment; no zone is UTC."""
    bare = F.regexp_replace(F.regexp_replace(line, r"\([^)]*\)", ""), r"^\s*[A-Za-z]{3,9},? +|\s+$", "")
    named = F.regexp_extract(bare, r" ([A-Z]{1,3})$", 1)
    zone = F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), named)
    bare = F.when(zone.isNotNull(), F.concat(F.regexp_replace(bare, r"[A-Z]{1,3}$", ""), zone)).otherwise(bare)
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm"]
    return F.coalesce(F.try_to_timestamp(line), *[F.try_to_timestamp(bare, F.lit(f)) for f in forms])


def emails(raw: DataFrame, to_text: Callable[[Column], Column] = html_to_text) -> DataFrame:
    """Messages to documents; those with neither subject nor body are dropped."""
    raw = with_body(spread_small(raw, "id"), to_text)
    h = raw["payload.headers"]
    rows = raw.select(
        "id", "threadId", "labelIds",
        header(h, "subject").alias("subject"), header(h, "from").alias("sender"),
        addresses(header(h, "to")).alias("recipients"), addresses(header(h, "cc")).alias("cc"),
        mail_date(header(h, "date")).alias("date"), "body",
    ).filter(~(blank(F.col("subject")) & blank(F.col("body"))))
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("# Email: "), "subject"),
        F.concat(F.lit("**From**: "), "sender"),
        F.concat(F.lit("**To**: "), F.array_join("recipients", ", ")),
        F.when(F.size("cc") > 0, F.concat(F.lit("**CC**: "), F.array_join("cc", ", "))),
        F.concat(F.lit("**Date**: "), F.date_format("date", "yyyy-MM-dd HH:mm:ss")),
        F.lit("## Content"),
        first_set(F.col("body")),
    )
    return rows.select(
        F.concat(F.lit("gmail_"), "id").alias("id"),
        F.lit("gmail").alias("source"),
        F.lit("email").alias("type"),
        F.col("subject").alias("title"),
        content.alias("content"),
        "subject", "sender", "recipients", "cc",
        F.col("labelIds").alias("labels"),
        F.col("threadId").alias("thread_id"),
        "date",
        F.concat(F.lit("https://mail.google.com/mail/u/0/#inbox/"), "threadId").alias("url"),
    )


def email_scope(df: DataFrame, domains=(), senders=(), labels=()) -> DataFrame:
    """OR inside each given group, AND between the groups."""
    sender = F.lower("sender")
    if domains:
        df = df.filter(F.lower(F.split_part("sender", F.lit("@"), F.lit(2))).isin([d.lower() for d in domains]))
    if senders:
        df = df.filter(sender.isin([s.lower() for s in senders]))
    if labels:
        df = df.filter(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])))
    return df


def added_ids(history: DataFrame) -> DataFrame:
    """Distinct ids of the messages that history pages report as added."""
    return history.select(F.explode("messagesAdded").alias("m")).select(F.col("m.message.id").alias("id")).distinct()

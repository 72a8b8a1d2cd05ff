"""Calendar records to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.functions.text import first_set


def calendar(raw: DataFrame) -> DataFrame:
    """Events that still take place, with attendees that have an address."""
    live = raw.filter(F.coalesce("status", F.lit("")) != "cancelled")
    start, end = (first_set(F.col(f"{c}.dateTime"), F.col(f"{c}.date")) for c in ("start", "end"))
    title = first_set(F.col("summary"), F.lit("No Title"))
    mails = F.filter(F.transform("attendees", lambda a: a["email"]), lambda m: F.coalesce(m, F.lit("")) != "")
    people = F.coalesce(mails, F.array().cast("array<string>"))
    organizer = F.col("organizer.email")
    text = lambda c: F.coalesce(c, F.lit(""))

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"**{label}**: "), first_set(value))

    content = F.concat_ws(
        "\n",
        F.concat(F.lit("# Event: "), title),
        F.lit(""),
        F.concat(F.lit("**When**: "), start, F.lit(" - "), end),
        line("Where", F.col("location")),
        line("Organizer", organizer),
        F.when(F.size("attendees") > 0, F.concat(F.lit("**Attendees**: "), F.array_join(people, ", "))),
        F.concat(F.lit("\n## Description\n"), first_set(F.col("description"))),
    )
    return live.select(
        "id",
        F.lit("calendar").alias("source"),
        F.lit("event").alias("type"),
        title.alias("title"),
        content.alias("content"),
        "description",
        "location",
        F.try_to_timestamp(start).alias("start"),
        F.try_to_timestamp(end).alias("end"),
        people.alias("attendees"),
        first_set(organizer, F.lit("unknown")).alias("organizer"),
        "status",
        F.try_to_timestamp("created").alias("created_at"),
        F.try_to_timestamp("updated").alias("updated_at"),
        F.concat_ws(" ", text(F.col("summary")), text(F.col("description")), text(F.col("location")), text(organizer)).alias("search_context"),
        F.col("htmlLink").alias("url"),
    )

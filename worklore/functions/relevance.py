"""Relevance features and scores per source, as column expressions.

``as_of`` is always a parameter; scores never exceed 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PUBLIC_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com"]
PRIORITY_WEIGHTS = {
    "Critical": 5, "Blocker": 5, "Highest": 5, "High": 4, "Medium": 3, "Low": 2, "Lowest": 1, "None": 1,
}
UNKNOWN_DAYS = 999


@dataclass(frozen=True)
class Identity:
    """Who the reader is; the issue tracker's mail is the fallback."""

    tracker_mail: str = ""
    office_mail: str = ""
    company_domains: tuple[str, ...] = ()


def _capped(*parts: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(F.lit(1.0), total)


def _if(cond: Column, value: float) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))


def is_internal(sender: Column, company_domains=()) -> Column:
    """Domain in the company list; with no list, any domain that is not public."""
    domain = F.lower(F.split_part(F.coalesce(sender, F.lit("")), F.lit("@"), F.lit(2)))
    wanted = [d.strip().lower() for d in company_domains if d.strip()]
    known = domain.isin(wanted) if wanted else ~domain.isin(PUBLIC_DOMAINS)
    return (domain != "") & known


def email_score(internal: Column, recipients: Column, depth: Column) -> Column:
    return _capped(F.lit(0.5), _if(internal, 0.2), _if(recipients <= 3, 0.15), _if(depth > 1, 0.1))


def channel_type(given: Column, channel: Column) -> Column:
    return F.coalesce(F.when(given != "", given), F.when(channel.startswith("DM"), "dm").otherwise("public"))


def chat_score(kind: Column, mentions: Column, in_thread: Column) -> Column:
    by_kind = F.when(kind == "dm", 0.3).when(kind == "private", 0.15).when(kind == "mpim", 0.2).otherwise(0.0)
    return _capped(F.lit(0.5), by_kind, _if(mentions > 0, 0.1), _if(in_thread, 0.05))


def priority_weight(priority: Column) -> Column:
    pairs = [F.lit(x) for kv in PRIORITY_WEIGHTS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), priority), F.lit(1))


def days_since(ts: Column, as_of: Column) -> Column:
    """Whole days, never below 0; a missing time counts as very old."""
    seconds = (F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))) / F.lit(86400000)
    # greatest() passes over nulls, so a missing time is asked for first.
    return F.when(ts.isNull(), F.lit(UNKNOWN_DAYS)).otherwise(F.greatest(F.lit(0), F.floor(seconds))).cast("long")


def is_me(source: Column, value: Column, who: Identity) -> Column:
    """Case-blind match with the reader's address for that source."""
    tracker, office = who.tracker_mail.lower(), (who.office_mail or who.tracker_mail).lower()
    v = F.lower(value)
    mine = F.when(source == "jira", v == tracker).when(
        source.isin("drive", "calendar", "gmail"), (v == office) if office else F.lit(False)
    )
    return F.coalesce((v != "") & mine, F.lit(False))


def issue_score(mine: Column, weight: Column, days: Column) -> Column:
    fresh = F.when(days < 7, 0.15).when(days < 30, 0.05).otherwise(0.0)
    return _capped(F.lit(0.3), _if(mine, 0.3), F.coalesce(weight, F.lit(1)) * F.lit(0.06), fresh)


def file_score(owner: Column, days: Column) -> Column:
    fresh = F.when(days < 7, 0.2).when(days < 30, 0.1).otherwise(0.0)
    return _capped(F.lit(0.4), _if(owner, 0.2), fresh)


def page_score(labels: Column, depth: Column, days: Column) -> Column:
    fresh = F.when(days < 7, 0.2).when(days < 30, 0.1).otherwise(0.0)
    return _capped(F.lit(0.4), _if(labels > 0, 0.15), _if(depth <= 2, 0.1), fresh)


def meeting_score(organizer: Column, attendees: Column, start: Column, as_of: Column) -> Column:
    hours = (F.unix_millis(start.cast("timestamp")) - F.unix_millis(as_of.cast("timestamp"))) / F.lit(3600000)
    soon = F.when((hours >= 0) & (hours <= 24), 0.2).when((hours >= 0) & (hours <= 168), 0.1).otherwise(0.0)
    return _capped(F.lit(0.5), _if(organizer, 0.2), _if(attendees <= 5, 0.1), soon)

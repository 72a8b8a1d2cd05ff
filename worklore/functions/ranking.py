"""Score expressions of the search ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
K1, B, TITLE_BOOST = 1.2, 0.75, 3.0
DECAY_WEIGHT, DECAY_OFFSET_MS, DECAY_SCALE_MS = 0.3, 604800000, 2592000000
HALF_LIFE_DAYS = {"slack": 7, "calendar": 14, "gmail": 14, "jira": 30, "confluence": 90, "drive": 90}
DEFAULT_HALF_LIFE = 30
VECTOR_K = 200
RESCORE_N = 200


def decay(updated_ms: Column, as_of_ms: int) -> Column:
    """Weight of the last update: whole for a week, then halved every 30 days."""
    age = F.greatest(F.lit(0), F.lit(as_of_ms) - updated_ms - F.lit(DECAY_OFFSET_MS))
    halves = age / F.lit(DECAY_SCALE_MS)
    return F.lit(DECAY_WEIGHT) * F.coalesce(F.pow(F.lit(0.5), halves), F.lit(1.0))


def half_life(source: Column) -> Column:
    pairs = [F.lit(x) for kv in HALF_LIFE_DAYS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit(DEFAULT_HALF_LIFE))


def recency(source: Column, ts: Column, as_of_ms: int) -> Column:
    """Half for every half-life of the source; 0 with no date."""
    days = F.greatest(F.lit(0), F.lit(as_of_ms) - F.unix_millis(ts.cast("timestamp"))) / F.lit(86400000)
    return F.when(ts.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), days / half_life(source)))


def ownership(owner: Column, assigned: Column) -> Column:
    """``owner``: owns, organizes or wrote it."""
    return F.when(owner, 1.0).when(assigned, 0.8).otherwise(0.0)


def engagement(source, reactions, mentions, thread_ts, weight, depth, labels) -> Column:
    """How much others took part, 0 to 1, by source."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    chat = zero(reactions) * 0.1 + zero(mentions) * 0.15 + F.when(F.coalesce(thread_ts, F.lit("")) != "", 0.2).otherwise(0.0)
    return (
        F.when(source == "slack", F.least(F.lit(1.0), chat))
        .when(source == "jira", F.least(F.lit(1.0), zero(weight) / 5))
        .when(source == "gmail", F.when(depth > 3, 0.6).when(depth > 1, 0.3).otherwise(0.0))
        .when(source == "confluence", F.least(F.lit(1.0), zero(labels) * 0.15))
        .otherwise(0.0)
    )


def multi_chunk(score: Column, n: Column) -> Column:
    """A document hit in several chunks ranks a little higher."""
    return F.when(n > 1, score * (1 + F.least(F.log(n) * 0.05, F.lit(0.15)))).otherwise(score)


def personalised(score, recent, owner, engaged, relevance) -> Column:
    return score * (1 + 0.20 * recent + 0.10 * owner + 0.05 * engaged + 0.10 * F.coalesce(relevance, F.lit(0.0)))

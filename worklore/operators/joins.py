"""Joins that leave rows out of the shuffle when they cannot match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_where(df: DataFrame, other: DataFrame, on: list[str] | str, can_match: Column) -> DataFrame:
    """Left join for the rows that can match; the others pass by with nulls.

    Null keys would all meet in one task, and a wide table would be shuffled
    for the few rows that have a key.
    """
    can_match = F.coalesce(can_match, F.lit(False))
    keys = [on] if isinstance(on, str) else on
    added = [f for f in other.schema.fields if f.name not in keys]
    joined = df.filter(can_match).join(other, keys, "left")
    rest = df.filter(~can_match).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return joined.unionByName(rest)

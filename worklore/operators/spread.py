"""Numbering, running sums and look-backs that no hot key turns into one long task.

A window over a key holds all rows of that key in one task.  Here rows are
sorted by ranges of (keys, order), so ranges are equally long whatever the keys
are, and written with the number of their range.  Each range is windowed alone.
A key that goes on over range borders, at most one per border, takes what its
earlier ranges carry over: a table with two rows per range at most, which is
why it can be broadcast.

The order must tell all rows of a key apart, or those it does not stay
together in one range.  Rows are written while the result is being built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklore.session import materialize

#: How a kind of running value is aggregated, and put together with what is carried over.
KINDS = {
    "sum": (F.sum, lambda carried, inside: F.coalesce(carried, F.lit(0)) + inside),
    "xor": (F.bit_xor, lambda carried, inside: F.coalesce(carried, F.lit(0).cast("long")).bitwiseXOR(inside)),
}


def _dealt(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_r``, the number of their range, and ``_k``, their keys; and the keys that cross a border."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    marked = df.withColumn("_k", key)
    rows = materialize(marked.repartitionByRange(n, "_k", *order).withColumn("_r", F.spark_partition_id()), "ranges")
    edges = rows.groupBy("_r").agg(F.min("_k").alias("_low"), F.max("_k").alias("_k"))
    follows = F.lead("_low").over(Window.orderBy("_r"))
    return rows, edges.withColumn("_next", follows).filter(F.col("_next") == F.col("_k")).select("_k").distinct()


def _windowed(rows: DataFrame, order: list[Column]):
    """Rows back in their ranges, one task each, and the window inside them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, F.col("_r")), Window.partitionBy("_r", "_k").orderBy(*order)


def running(df: DataFrame, keys: list[str], order: list[Column], **values: tuple[str, Column]) -> DataFrame:
    """Running values per key, this row included: ``name=(kind, column)`` with kind sum or xor."""
    df = df.withColumns({f"_v_{name}": value for name, (_, value) in values.items()})
    rows, crossing = _dealt(df, keys, order)
    per_range = rows.join(F.broadcast(crossing), "_k", "left_semi").groupBy("_k", "_r").agg(
        *[KINDS[kind][0](f"_v_{name}").alias(f"_v_{name}") for name, (kind, _) in values.items()]
    )
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_range.select("_k", "_r", *[KINDS[kind][0](f"_v_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in values.items()])
    ranges, inside = _windowed(rows, order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = ranges.withColumns({f"_v_{name}": KINDS[kind][0](f"_v_{name}").over(upto) for name, (kind, _) in values.items()})
    joined = joined.join(F.broadcast(carried), ["_k", "_r"], "left")
    done = joined.withColumns({name: KINDS[kind][1](F.col(f"_c_{name}"), F.col(f"_v_{name}")) for name, (kind, _) in values.items()})
    return done.drop("_k", "_r", *[f"{p}_{name}" for name in values for p in ("_v", "_c")])


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` per key, this row included."""
    return running(df, keys, order, **{out: ("sum", value)})


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "rn") -> DataFrame:
    """Row number per key, from 1; over all rows if there are no keys."""
    return running(df, keys, order, **{out: ("sum", F.lit(1).cast("long"))})


def previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """``prev_<col>`` of the row before, per key, across range borders."""
    rows, crossing = _dealt(df, keys, [F.col(c) for c in order])
    pack = F.struct(*order, *[F.col(c).alias(f"_p_{c}") for c in cols])
    last = rows.join(F.broadcast(crossing), "_k", "left_semi").groupBy("_k", "_r").agg(F.max(pack).alias("_last"))
    carried = last.select("_k", "_r", F.lag("_last").over(Window.partitionBy("_k").orderBy("_r")).alias("_carry"))
    ranges, inside = _windowed(rows, [F.col(c) for c in order])
    own = ranges.withColumn("_first", F.row_number().over(inside) == 1).withColumns({f"prev_{c}": F.lag(c).over(inside) for c in cols})
    joined = own.join(F.broadcast(carried), ["_k", "_r"], "left")
    filled = {f"prev_{c}": F.when(F.col("_first"), F.col(f"_carry._p_{c}")).otherwise(F.col(f"prev_{c}")) for c in cols}
    return joined.withColumns(filled).drop("_k", "_r", "_first", "_carry")

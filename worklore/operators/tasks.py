"""Scheduled tasks, record queries, corrections, near-equal entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklore.operators.spread import numbered, previous
from worklore.session import materialize, spread_small

# Fixed values.
HOME_ZONE = "Asia/Jerusalem"
FIELD_RANGES = [("minute", 0, 59), ("hour", 0, 23), ("dom", 1, 31), ("month", 1, 12), ("dow", 0, 7)]
WHEN_LINE = r"\*\*When\*\*: *([^\n]*)"
MEANT_LINE = r"\*\*Correct interpretation\*\*: *([^\n]*)"
WORD = r"[\p{L}\p{N}]+"
SHINGLE = 3
#: Numbers (8 bytes each) up to which the sets worth a second look are broadcast.
BROADCAST_ROWS = 400_000


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def due(tasks: DataFrame, as_of: str) -> DataFrame:
    """Not run yet and due; oldest first."""
    return tasks.filter(~F.col("executed") & (F.col("execute_at") <= ts(as_of))).orderBy("execute_at", "task_id")


def agenda(tasks: DataFrame, day: str) -> DataFrame:
    """Tasks of a day, run or not."""
    return tasks.filter((F.col("execute_at") >= ts(day)) & (F.col("execute_at") < ts(day) + F.expr("INTERVAL '1' DAY"))).orderBy("execute_at", "task_id")


def to_utc(col: Column, zone: str = HOME_ZONE) -> Column:
    return F.to_utc_timestamp(col, zone)


def from_utc(col: Column, zone: str = HOME_ZONE) -> Column:
    return F.from_utc_timestamp(col, zone)


def roll(time_of_day: Column, as_of: str) -> Column:
    """Today at that time (``HH:mm``, UTC) if still to come, else tomorrow."""
    today = F.to_timestamp(F.concat(F.date_format(ts(as_of), "yyyy-MM-dd"), F.lit(" "), time_of_day), "yyyy-MM-dd HH:mm")
    return F.when(today > ts(as_of), today).otherwise(today + F.expr("INTERVAL '1' DAY"))


def _field_set(field: Column, low: int, high: int) -> Column:
    """Numbers a schedule field stands for: lists, ranges, steps, ``*``."""

    def part(p: Column) -> Column:
        span = F.split_part(p, F.lit("/"), F.lit(1))
        given_step = F.split_part(p, F.lit("/"), F.lit(2))
        step = F.when(given_step != "", given_step.cast("int")).otherwise(1)
        a = F.when(span == "*", F.lit(low)).otherwise(F.split_part(span, F.lit("-"), F.lit(1)).try_cast("int"))
        to = F.split_part(span, F.lit("-"), F.lit(2))
        b = F.when(span == "*", F.lit(high)).when(to != "", to.try_cast("int")).when(given_step != "", F.lit(high)).otherwise(a)
        return F.sequence(a, b, step)

    return F.array_distinct(F.flatten(F.transform(F.split(field, ","), part)))


def expand(tasks: DataFrame, start: str, end: str) -> DataFrame:
    """(task_id, run_at): the runs of recurring tasks in [start, end).

    Every distinct schedule is expanded once, day by day, into the runs it
    really has; tasks then join their schedule.  Both day fields restricted
    means either may match.
    """
    plans = tasks.filter(F.col("recurrence").isNotNull()).select("recurrence").distinct()
    parts = F.split(F.trim("recurrence"), r"\s+")
    sets = plans.select(
        "recurrence", *[_field_set(parts[i], lo, hi).alias(name) for i, (name, lo, hi) in enumerate(FIELD_RANGES)],
        (parts[2] == "*").alias("any_dom"), (parts[4] == "*").alias("any_dow"),
    )
    days = sets.withColumn("day", F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))))
    wd = F.dayofweek("day") - 1
    on_dom = F.array_contains("dom", F.dayofmonth("day"))
    on_dow = F.array_contains("dow", wd) | ((wd == 0) & F.array_contains("dow", F.lit(7)))
    on_day = F.when(F.col("any_dom") | F.col("any_dow"), on_dom & on_dow).otherwise(on_dom | on_dow)
    hits = days.filter(F.array_contains("month", F.month("day")) & on_day)
    runs = hits.select("recurrence", "day", "minute", F.explode("hour").alias("h")).select(
        "recurrence", "day", "h", F.explode("minute").alias("m")
    ).select(
        "recurrence",
        (F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("h"), F.col("m"))).alias("run_at"),
    ).filter((F.col("run_at") >= ts(start)) & (F.col("run_at") < ts(end)))
    joined = tasks.select("task_id", "recurrence", "recurrence_end").join(runs, "recurrence")
    return joined.filter(F.col("recurrence_end").isNull() | (F.col("run_at") <= F.col("recurrence_end"))).select("task_id", "run_at")


OPS = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "like": lambda c, v: c.like(v), "in": lambda c, v: c.isin(v),
    "is_null": lambda c, v: c.isNull(), "not_null": lambda c, v: c.isNotNull(),
}


def records(df: DataFrame, where=(), sort=(), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows that meet all (field, op, value); ``sort`` fields, ``-`` for down."""
    for field, op, value in where:
        df = df.filter(OPS[op](F.col(field), value))
    if sort:
        df = df.orderBy(*[F.desc(s[1:]) if s.startswith("-") else F.asc(s) for s in sort])
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


# -- corrections ---------------------------------------------------------------


def write_corrections(df: DataFrame, path: str) -> None:
    """Numbered Markdown sections in one folder per domain."""
    line = F.concat(
        F.lit("## "), F.col("idx").cast("string"), F.lit(". "), "title", F.lit("\n**When**: "), "when", F.lit("\n**Correct interpretation**: "), "correction", F.lit("\n")
    )
    df.select("domain", line.alias("value")).write.partitionBy("domain").text(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(domain, idx, title, when, correction) from Markdown files.

    Files are split at section heads, so a large one is read by many tasks.
    The domain is the folder, else the file name.
    """
    rows = spark.read.option("lineSep", "\n## ").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    head = r"\A(?:## )?(\d+)\. *([^\n]*)"
    domain = F.coalesce(
        F.nullif(F.regexp_extract("file", r"domain=([^/]+)/", 1), F.lit("")), F.regexp_extract("file", r"([^/]+)\.md$", 1)
    )
    return rows.filter(F.col("value").rlike(head)).select(
        domain.alias("domain"), F.regexp_extract("value", head, 1).cast("long").alias("idx"), F.trim(F.regexp_extract("value", head, 2)).alias("title"),
        F.trim(F.regexp_extract("value", WHEN_LINE, 1)).alias("when"), F.trim(F.regexp_extract("value", MEANT_LINE, 1)).alias("correction"),
    )


def renumber(df: DataFrame) -> DataFrame:
    """New numbers without gaps per domain, in order of the old ones."""
    return numbered(df, ["domain"], [F.col("idx")], "new_idx")


# -- near-equal entries --------------------------------------------------------


def shingles(text: Column) -> Column:
    """Distinct hashes of three words in a row; a short text is one shingle."""

    def of_words(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(SHINGLE)), " ")))
        return F.when(n >= SHINGLE, F.array_distinct(windows)).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))

    # the word list is bound once, so the windows do not split the text again
    return F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), of_words)[0]


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _alone(sets: DataFrame) -> DataFrame:
    """(k1, alone): per set, how many shingles of one half of the hash space no other set has."""
    seen = sets.select("k1", F.explode(F.filter("s", lambda x: x < 0)).alias("x"))
    owners = seen.groupBy("x").agg(F.min("k1").alias("k1"), F.max("k1").alias("other"))
    return owners.filter(F.col("k1") == F.col("other")).groupBy("k1").agg(F.count(F.lit(1)).alias("alone"))


def _probes(sets: DataFrame, threshold: float) -> DataFrame:
    """(x, at, cid, n): the rarest shingles of each set, of which two sets that are alike share one; ``at`` is its place.

    Shingles that no other set has come first in the order, so they use up places.
    """
    rows = sets.select("cid", "n", F.explode("s").alias("x"))
    shared = rows.groupBy("x").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") > 1)
    own = Window.partitionBy("cid")
    known = rows.join(shared, "x").select("x", "cid", "n", F.count(F.lit(1)).over(own).alias("common"), F.row_number().over(own.orderBy("f", "x")).alias("place"))
    last = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9)
    at = F.col("n") - F.col("common") + F.col("place") - 1
    return known.select("x", at.alias("at"), "cid", "n").filter(at <= last)


def similar(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, similar): whether another entry is at least ``threshold`` alike.

    Exact, without comparing all members of a group of copies:
    1. entries with the same shingles are told by counting;
    2. a set with more than ``1 - t`` of its shingles to itself has no partner;
       one half of the hash space is counted, which rules out most texts, and
       only what is left is looked at further;
    3. these are put in order of two min-hashes, where near copies mostly stand
       side by side, and each is compared with its neighbours;
    4. only entries still without a partner look for one through rare
       shingles: two sets that are alike share one of their rarest
       ``n - ceil(t * n) + 1``, and behind the first that they share there must
       be enough of both, so nothing is missed.
    """
    made = spread_small(df, "id").select("id", F.array_sort(shingles(F.col("text"))).alias("s"))
    key = ["k1", "k2"]
    sets = materialize(made.select("id", F.monotonically_increasing_id().alias("row"), F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2"), F.size("s").alias("n"), "s"), "sets")
    classes = materialize(sets.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("cid"), F.min("n").alias("n")), "classes")
    left = classes.join(_alone(sets), "k1", "left").filter(F.col("n") - F.coalesce("alone", F.lit(0)) >= F.col("n") * threshold - 1e-9)
    wanted = materialize(left.select("cid"), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    groups = materialize(sets.join(few, F.col("row") == F.col("cid")).select("cid", "n", "s"), "candidates")

    def low(seed: int) -> Column:
        return F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(seed))))

    def alike(pairs: DataFrame) -> DataFrame:
        sides = [groups.select(F.col("cid").alias(c), F.col("s").alias(f"s{c}")) for c in ("a", "b")]
        met = pairs.join(sides[0], "a").join(sides[1], "b")
        return met.filter(_jaccard(F.col("sa"), F.col("sb")) >= threshold).select(F.explode(F.array("a", "b")).alias("cid"))

    # Only numbers and min-hashes are put in order; the sets are joined to the pairs.
    reps = groups.select("cid", low(1).alias("m1"), low(2).alias("m2"))
    side = previous(reps, [], ["m1", "m2", "cid"], ["cid"]).filter(F.col("prev_cid").isNotNull()).select(F.col("cid").alias("a"), F.col("prev_cid").alias("b"))
    done = materialize(classes.filter(F.col("copies") > 1).select("cid").unionByName(alike(side)).distinct(), "paired")

    probes = materialize(_probes(groups, threshold), "probes")
    open_ = probes.join(done, "cid", "left_anti").select(F.col("cid").alias("a"), F.col("n").alias("la"), F.col("at").alias("pa"), "x")
    enough = F.least(F.col("la") - F.col("pa"), F.col("lb") - F.col("pb")) * (1 + threshold) >= (F.col("la") + F.col("lb")) * threshold - 1e-6
    pairs = open_.join(probes.select(F.col("cid").alias("b"), F.col("n").alias("lb"), F.col("at").alias("pb"), "x"), "x").filter(
        (F.col("a") != F.col("b")) & (F.col("lb") >= F.col("la") * threshold - 1e-9) & (F.col("la") >= F.col("lb") * threshold - 1e-9) & enough
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = done.unionByName(alike(pairs)).distinct()
    known = classes.join(found, "cid").select(*key, F.lit(True).alias("similar"))
    return sets.select("id", *key).join(known, key, "left").select("id", F.coalesce("similar", F.lit(False)).alias("similar"))

"""Deletes repeated runs of lines: suffix array over line numbers by prefix doubling.

Texts are sequences of lines.  Lines that occur once cannot be in a repeated
run, so only stretches of the others are looked at.  Lines are numbered by a
distributed sort; round k numbers the runs of 2^k lines by sorting pairs of
numbers from round k - 1, which is the order of the suffixes up to that depth.

A run counts when it has ``least_words`` words.  At every line begins one
shortest such run, and at every line ends one; a longer repeated run is the
union of those inside it.  Two ranks that overlap name a run of any length:
suffixes with that name form an LCP interval, its first place keeps the lines
and every later place loses them.

Only DataFrame functions are used; texts are read twice and never shuffled
unless the list of cuts is too large to broadcast.

Defined cases: a null text stays null and has no lines; an empty one has one
empty line; documents are ordered by id (null last), then text key; rows equal
in id and text are one document and lose the same lines; a document that loses
all its lines has an empty text; other columns stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklore.llm.common import free_name, gathered, materialize, text_key

LEAST_WORDS = 50
#: Cut documents, and cuts, up to which the list (about 60 bytes each) is broadcast.
BROADCAST_ROWS = 400_000
DOC = ["no_id", "doc_id", "text_key"]
LINE = "\n"


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line: its document, place, 128-bit hash and words."""
    keyed = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text").where("text is not null")
    lines = keyed.select(*DOC, F.posexplode(F.split("text", LINE)).alias("pos", "line"))
    return lines.select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(r"\S+")).alias("words"))


def numbered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """A number for each pair that occurs more than once, in the order of the pairs."""
    often = pairs.where(F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("times")).where("times > 1")
    return materialize(often.orderBy("x", "y").select("x", "y", F.monotonically_increasing_id().alias("rank")), "ranks")


def stretches(lines: DataFrame) -> DataFrame:
    """Repeated lines with their rank, stretch and running words before and after each."""
    ranks = numbered(lines, "h1", "h2")
    known = lines.join(ranks, (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y"))).select(*DOC, "pos", "words", F.col("rank").alias("r0"))
    order = Window.partitionBy(*DOC).orderBy("pos")
    run = known.withColumn("stretch", F.col("pos") - F.row_number().over(order))
    upto = F.sum("words").over(Window.partitionBy(*DOC, "stretch").orderBy("pos"))
    return run.withColumn("after", upto).withColumn("before", F.col("after") - F.col("words"))


def shortest_runs(rows: DataFrame, least_words: int) -> DataFrame:
    """(document, stretch, from_pos, size, end): the shortest run that starts or ends at each line.

    Marks and questions are sorted together: the last mark seen before a
    question is the line that the run reaches to.
    """
    own = [*DOC, "stretch"]
    line = lambda key, ask, pos: F.struct(key.cast("long").alias("key"), F.lit(ask).alias("ask"), pos.alias("pos"))
    pos, before, after = F.col("pos"), F.col("before"), F.col("after")
    last = Window.partitionBy(*own)
    # Starts: the first line whose words are all after the run; the stretch's end stands for none.
    asked = rows.select(*own, F.inline(F.array(line(before, 0, pos), line(before + least_words, 1, pos), line(after, 0, pos + 1))))
    back = last.orderBy(F.desc("key"), "ask", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    starts = asked.withColumn("to", F.last(F.when(F.col("ask") == 0, F.col("pos")), ignorenulls=True).over(back)).where("ask = 1 and to is not null")
    starts = starts.select(*own, "pos", (F.col("to") - F.col("pos")).alias("size"), F.lit(False).alias("end"))
    # Ends: the last line that has enough words from its begin.
    asked = rows.select(*own, F.inline(F.array(line(before, 0, pos), line(after - least_words, 1, pos))))
    forth = last.orderBy("key", "ask", "pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = asked.withColumn("from", F.last(F.when(F.col("ask") == 0, F.col("pos")), ignorenulls=True).over(forth)).where("ask = 1 and from is not null")
    ends = ends.select(*own, F.col("from").alias("at"), (F.col("pos") - F.col("from") + 1).alias("size"), F.lit(True).alias("end"))
    return starts.unionByName(ends.withColumnRenamed("at", "pos"))


def cuts(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(no_id, doc_id, text_key, start, stop): line ranges that repeat an earlier run, merged."""
    lines = line_table(docs)
    lines = materialize(lines, "lines")
    if not docs.groupBy(F.col("doc_id"), text_key(F.col("text")).alias("k")).count().where("count > 1").isEmpty():
        lines = lines.dropDuplicates([*DOC, "pos"])
    rows = materialize(stretches(lines), "stretches")
    own = [*DOC, "stretch"]
    runs = materialize(shortest_runs(rows, least_words).withColumn("level", F.floor(F.log2("size")).cast("int")), "runs")
    deepest = runs.agg(F.max("level")).first()[0]
    if deepest is None:
        empty = rows.select(*DOC, F.col("pos").alias("start"), F.col("pos").alias("stop")).limit(0)
        return empty

    def named_runs():
        ranks = rows.select(*own, "pos", F.col("r0").alias("r"))
        for level in range(deepest + 1):
            if level:
                half = 1 << (level - 1)
                # Runs that occur once have no rank and leave gaps, so the next half is found by its place.
                ahead = F.max("r").over(Window.partitionBy(*own).orderBy("pos").rangeBetween(half, half))
                pairs = ranks.withColumn("next", ahead).where("next is not null")
                named = numbered(pairs, "r", "next")
                ranks = materialize(pairs.join(named, (F.col("r") == F.col("x")) & (F.col("next") == F.col("y"))).select(*own, "pos", F.col("rank").alias("r")), "suffixes")
            # Runs of 2^level up to 2^(level + 1) - 1 lines: a rank at either end names them.
            here = runs.where(F.col("level") == level).drop("level")
            first = here.join(ranks, [*own, "pos"]).withColumnRenamed("r", "head").withColumn("tail_pos", F.col("pos") + F.col("size") - (1 << level))
            tail = ranks.select(*own, F.col("pos").alias("tail_pos"), F.col("r").alias("tail"))
            yield first.join(tail, [*own, "tail_pos"]).select(*DOC, "pos", "size", "end", "head", "tail", F.lit(level).alias("level"))

    places = gathered(named_runs(), "places")
    interval = ["level", "size", "end", "head", "tail"]
    here = F.struct(*DOC, "pos")
    earliest = places.groupBy(*interval).agg(F.min(here).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    later = places.join(earliest, interval).where(here != F.col("first")).select(*DOC, F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("stop")).distinct()
    # Ranges that meet become one.
    order = Window.partitionBy(*DOC).orderBy("start", "stop")
    reach = later.withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    islands = reach.withColumn("island", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(order))
    return islands.groupBy(*DOC, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> tuple[DataFrame, str, str]:
    """``docs`` with later copies of line runs cut out of ``text``, and the names of two added columns:
    lines before, lines cut."""
    ranges = cuts(docs, least_words).groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("ranges"))
    ranges = materialize(ranges.withColumnsRenamed({c: f"cut_{c}" for c in DOC}), "cuts")
    rows, most = ranges.agg(F.count("*"), F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()
    ranges = F.broadcast(ranges) if max(rows, most) <= BROADCAST_ROWS else ranges
    names = docs.columns
    lines, gone, mark = free_name(docs, "n_lines"), free_name(docs, "n_removed"), free_name(docs)
    keyed = docs.select(*names, F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), text_key(F.col("text")).alias("text_key")).alias(mark))
    same = reduce(lambda a, b: a & b, [F.col(f"{mark}.{c}") == F.col(f"cut_{c}") for c in DOC])
    joined = keyed.join(ranges, same, "left")
    split = F.split("text", LINE)
    inside = lambda i: F.exists("ranges", lambda r: (r["start"] <= i) & (i < r["stop"]))
    kept = F.array_join(F.filter(split, lambda line, i: ~inside(i)), LINE)
    removed = F.coalesce(F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"]), F.lit(0).cast("long"))
    out = [F.when(F.col("ranges").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in names]
    return joined.select(*out, F.coalesce(F.size(split).cast("long"), F.lit(0).cast("long")).alias(lines), removed.alias(gone)), lines, gone


def report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: lines, lines cut, and the digest of what is left."""
    found, lines, gone = dedup(docs.select("doc_id", "text"), least_words)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.col(lines)).cast("long").alias("n_lines"), F.col(gone).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def drop_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with repeats cut out of their texts; those that had nothing else go."""
    found, lines, gone = dedup(docs, least_words)
    return found.where((F.col(gone) == 0) | (F.col(gone) < F.col(lines))).drop(lines, gone)

"""Exact Jaccard join of shingle sets in regions around pivots.

With d = 1 - J a metric, two sets link when d <= 1/4.  Unrelated texts are all
at distance 1 from one another, so pivots picked among them at random would
part nothing; here regions come from what sets share:

1. Sieve.  A set with more than a quarter of its shingles to itself has no
   partner.  A fixed part of the hash space is counted first, which rules out
   most texts; the rest is counted in full.
2. Pivots.  Shingles are ordered rare first; linked sets share one of the first
   ``n - ceil(3n/4) + 1``.  All sets with such a shingle form a region; its
   pivot is the most typical set in it.  A set is thereby replicated to every
   region a partner of it can be in.
3. Distances to the pivots link the inner balls (d <= 1/4) at once.
4. Recursion.  What lies outside a ball is compared with the rest of its region,
   unless the triangle inequality, the sizes, the shingles each has alone, or an
   already known component rule the pair out.

Copies are one class from the start, so neither they nor near copies of one
text are expanded into pairs: a region costs its size plus what is left over.

Defined cases: null, empty and wordless texts have no shingles and link with
nothing; repeated rows and ids are rows of their own with equal results; a null
id is larger than any other; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklore.llm import textbytes as tb
from worklore.llm.common import free_name, keyed_docs, materialize, text_key, tidy
from worklore.llm.components import components, extended
from worklore.llm.shingles import set_keys, sets_of
from worklore.session import prepare

#: Part of the hash space that the first count looks at; over 1/4, so that it can rule out a text with all its shingles to itself.
SIEVE = 5 / 16
SIEVE_BITS = 48
#: Rows (24 bytes each) up to which the texts worth a second look are broadcast.
BROADCAST_ROWS = 400_000


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, c1, c2): size and 128-bit key of every document's set."""

    def work(batches):
        for batch in batches:
            for first, rows, bounds, code in sets_of(batch.column(2)):
                c1, c2 = set_keys(bounds, code)
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds)), pa.array(c1), pa.array(c2)], names=["doc_id", "text_key", "n", "c1", "c2"])

    return keyed_docs(docs).select("doc_id", "text_key", "text").mapInArrow(tidy(work), "doc_id long, text_key long, n long, c1 long, c2 long")


def alone_in_sieve(docs: DataFrame) -> DataFrame:
    """(c, alone): per set key, how many shingles of the sieve no other set has."""
    limit = tb.U64(int(SIEVE * (1 << 64)))
    short = tb.U64(64 - SIEVE_BITS)

    def work(batches):
        for batch in batches:
            for _, rows, bounds, code in sets_of(batch.column(0)):
                c1, _ = set_keys(bounds, code)
                owner = np.repeat(c1.view(tb.U64) >> short, np.diff(bounds))
                low = code < limit
                # Shortened shingle codes may only make one look shared that is not.
                yield pa.RecordBatch.from_arrays([pa.array((code[low] >> short).view(np.int64)), pa.array(owner[low].view(np.int64))], names=["h", "c"])

    seen = docs.select("text").mapInArrow(tidy(work), "h long, c long")
    return seen.groupBy("h").agg(F.min("c").alias("c"), F.max("c").alias("other")).where("c = other").groupBy("c").agg(F.count("*").alias("alone"))


def worth_a_look(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(cid, c1, c2, n, doc_id, text_key): one row per set that the sieve leaves, with a document that has it."""
    classes = table.where("n > 0").groupBy("c1", "c2", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("at"))
    key = F.shiftrightunsigned("c1", 64 - SIEVE_BITS)
    left = classes.withColumn("c", key).join(alone_in_sieve(docs), "c", "left").where("4 * coalesce(alone, 0) <= n")
    return materialize(left.select(F.monotonically_increasing_id().alias("cid"), "c1", "c2", F.col("n").cast("int").alias("n"), "at.doc_id", "at.text_key"), "candidates")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, n, hs): the shingle hashes of the wanted sets."""
    keys = wanted.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "cid", F.col("n").alias("size"))
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_ROWS else keys
    texts = keyed_docs(docs)
    # A repeated row gives its set again; links() keeps one.
    texts = texts.join(keys, texts.doc_id.eqNullSafe(F.col("id")) & (texts.text_key == F.col("key"))).select("cid", "size", "text")

    def work(batches):
        for batch in batches:
            for first, rows, bounds, code in sets_of(batch.column(2)):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(code.view(np.int64)))
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["cid", "n", "hs"])

    return texts.mapInArrow(tidy(work), "cid long, n int, hs array<long>")


def regions(sets: DataFrame) -> DataFrame:
    """(h, at, cid, n, alone, typical): the sets of each region; h is the shingle they share, at place ``at`` of the set."""
    rows = sets.select("cid", "n", F.explode("hs").alias("h"))
    shared = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("cid")
    known = rows.join(shared, "h").select("h", "df", "cid", "n", F.count("*").over(own).alias("common"), (F.sum(F.ln("df")).over(own) / F.col("n")).alias("typical"), F.row_number().over(own.orderBy("df", "h")).alias("place"))
    known = known.withColumn("alone", F.col("n") - F.col("common"))
    # Unshared shingles come first in the order, so they use up the prefix.
    return known.where("4 * alone <= n and place + alone <= n - (3 * n + 3) div 4 + 1").select("h", (F.col("place") + F.col("alone") - 1).alias("at"), "cid", "n", "alone", "typical")


#: Overlap a pair may have at most, by what is known of each: the shingles from the shared one on (those before it
#: are not shared, if it is the first that is), and those in the pivot or else not alone.
POSSIBLE = """
  7 * least(x.n - x.at, y.n - y.at) >= 3 * (x.n + y.n)
  and 7 * (least(x.with_pivot, y.with_pivot) + least(x.n - x.with_pivot - x.alone, y.n - y.with_pivot - y.alone)) >= 3 * (x.n + y.n)
"""


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, d, linked): overlap, exact Jaccard distance, and whether the pair links."""
    side = lambda s: sets.select(F.col("cid").alias(s), F.col("hs").alias(f"hs_{s}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b")
    found = found.select("a", "b", F.size(F.array_intersect("hs_a", "hs_b")).alias("both"), (F.size("hs_a") + F.size("hs_b")).alias("sizes"))
    union = F.col("sizes") - F.col("both")
    return found.select("a", "b", "both", (1 - F.col("both") / union).alias("d"), (100 * F.col("both") >= 75 * union).alias("linked"))


def links(docs: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class candidates, components of the linked ones by cid)."""
    wanted = worth_a_look(docs, table)
    sets = shingle_sets(docs, wanted)
    if not table.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["cid"])
    sets = materialize(sets, "sets")
    area = materialize(regions(sets), "regions")
    pivots = area.groupBy("h").agg(F.max_by("cid", F.struct("typical", -F.col("cid"))).alias("p"))
    member = materialize(area.join(pivots, "h").where("cid != p"), "members")
    near = materialize(distances(member.select(F.col("p").alias("a"), F.col("cid").alias("b")).distinct(), sets), "pivots")
    label = components(near.where("linked").select("a", "b"))
    # The regions again, each set with its distance to the pivot and its component so far.
    seen = member.join(near.select(F.col("a").alias("p"), F.col("b").alias("cid"), "d", "linked", F.col("both").alias("with_pivot")), ["p", "cid"])
    seen = seen.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    left, right = seen.where("not linked").alias("x"), seen.alias("y")
    rest = left.join(right, F.expr(f"x.h = y.h and x.label != y.label and (y.linked or x.cid < y.cid) and abs(x.d - y.d) <= 0.2500001D and {POSSIBLE}"))
    rest = materialize(rest.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct(), "rest")
    return wanted, extended(label, distances(rest, sets).where("linked").select("a", "b"))


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, component_id, part) per document; ``part`` names its component, null without shingles."""
    prepare(docs.sparkSession)
    table = materialize(set_table(docs), "set-table")
    wanted, label = links(docs, table)
    named = wanted.join(label, F.col("cid") == F.col("node")).select("c1", "c2", "label")
    firsts = table.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = materialize(firsts.join(named, ["c1", "c2"], "left").where("copies > 1 or label is not null"), "classes")
    linked = classes.where("label is not null")
    whole = linked.groupBy("label").agg(F.min("first").alias("smallest"), F.min("c1").alias("part"))
    groups = linked.join(whole, "label").select("c1", "c2", "smallest", "part")
    copies = classes.where("label is null").select("c1", "c2", F.col("first").alias("smallest"), F.col("c1").alias("part"))
    known = groups.union(copies).withColumnsRenamed({"c1": "g1", "c2": "g2"})
    joined = table.join(known, (F.col("c1") == F.col("g1")) & (F.col("c2") == F.col("g2")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", "text_key", "n", F.coalesce("smallest", "doc_id").alias("component_id"), F.when(F.col("n") > 0, F.coalesce("part", "c1")).alias("part"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id)."""
    return grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, with one of each component: the smallest id, then text key.

    Only the keys of what goes are joined with the texts.
    """
    rows = materialize(grouped(docs), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    many = rows.where("part is not null").groupBy(F.col("part").alias("of")).agg(F.min(order).alias("best"), F.count("*").alias("size")).where("size > 1")
    inside = rows.join(many, F.col("part") == F.col("of"))
    spare = inside.where(~order.eqNullSafe(F.col("best"))).select("doc_id", "text_key").distinct()
    again = inside.where(order.eqNullSafe(F.col("best"))).groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    return without_keys(docs, materialize(spare.withColumn("once", F.lit(False)).union(again.withColumn("once", F.lit(True))), "spare"))


def without_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` not named by ``keys`` (doc_id, text_key, once); where ``once`` is set, one of the rows stays."""
    names, mark = docs.columns, free_name(docs)
    keys = keys.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key"), F.col("once").alias("k_once"))
    keyed = docs.select(*names, F.struct(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key")).alias(mark))
    same = F.col(f"{mark}.id").eqNullSafe(F.col("k_id")) & (F.col(f"{mark}.key") == F.col("k_key"))
    kept = keyed.join(keys, same, "left_anti").select(*names)
    if keys.where("k_once").isEmpty():
        return kept
    return kept.union(keyed.join(keys.where("k_once"), same, "left_semi").dropDuplicates([mark]).select(*names))

"""A stored inverted index: postings bucketed by term, in blocks of documents.

Layout, one folder per batch of documents:

- ``forward``: documents with their number, date, counted terms and, for a
  chunk, the document it is a part of; parts stay side by side as they came;
- ``postings``: one row per (term, field, block of 512 documents) with the
  places in the block and the times as two lists and, beside them, how many
  there are, the largest times, smallest length and latest date.  They are made
  and written where the documents lie, without a shuffle; lengths and dates of
  single documents stay in ``forward``.  They are sorted by term
  and lie in folders by term bucket, so a search opens only the buckets of the
  terms asked for, and takes the entries only of blocks that can matter;
- ``stats``: per field, documents with words and their total length;
- ``dead``: numbers and lengths of documents of earlier batches that this one
  replaces; a search takes them out of its terms' counts by their places.

The manifest names the batches.  Its row is written last, so a load that is
killed leaves the index as it was.

A search for the best ``k`` has two steps per query.  The numbers beside the
entries bound what a document of a block can score; the blocks with the highest
bounds are scored first, and of the others only those whose bound reaches the
k-th best score so far.  Blocks are scored whole in a task, where each keeps
its best ``k``; only these are shuffled.

A search for the best part of each document cuts where blocks are scored, too:
a document with all its parts in one block has one row per query from there,
final and under its name.  Only hits of documents that cross blocks are left to
be put together.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklore.functions import ranking as R
from worklore.functions import text as T
from worklore.session import fresh_path, materialize, spread_small

TOKEN = r"[\p{L}\p{N}]+"
BUCKETS = 64
#: Document numbers: block and place in it, and above them the batch.
BLOCK_BITS, BATCH_BITS = 9, 53
#: Blocks whose postings of one bucket share a file in an index for one search, as a power of two.
GROUP_BITS = 10
QUERY_BLOCK = 1024
#: Blocks with dead documents (up to 1 KB each) that go to the documents; beyond that these are shuffled to them.
BROADCAST_BLOCKS = 100_000
#: Counted terms that a task turns into postings at a time (some 100 bytes each), unless one document has more.
STEP_TERMS = 1 << 20
#: Sums come in any order.  Scores are held on a grid of 2**-30, so that equal
#: scores stay equal on every run and ties fall to the id.
GRID = 2**30
#: In place of a field: rows that have a document's lengths and date, or say that it is dead.
DOCUMENT, DEAD = -2, -1
#: Stands for no date, which weighs as the latest.
NO_DATE = (1 << 63) - 1
POSTINGS = """term string, field int, block long, n long, max_tf int, min_len int, max_at long,
    entries array<struct<doc: long, tf: int, len: int, at: long>>"""
STORED = "bucket int, term string, field int, block long, n long, max_tf int, min_len int, max_at long, places array<short>, times array<int>"
MANIFEST = "batch int, folder string, from_batch int"
#: Best parts of documents, with the hits that a row stands for.
BEST = "id string, parent_doc_id string, score double, n_chunks long"


def steady(score: Column) -> Column:
    return F.floor(score * GRID + 0.5) / F.lit(float(GRID))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, times) of the normalised queries."""
    words = queries.select("qid", F.explode(tokens(T.norm_query(F.col("query")))).alias("term"))
    return words.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def bucket(term: Column) -> Column:
    return (F.crc32(term) % BUCKETS).cast("int")


def block_of(doc: Column) -> Column:
    return F.shiftright(doc, BLOCK_BITS)


def place_of(doc: Column) -> Column:
    return doc.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("short")


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, gone): the places of these documents in each block."""
    return docs.groupBy(block_of(F.col("doc")).alias("block")).agg(F.collect_set(place_of(F.col("doc"))).alias("gone"))


def counted(col: Column) -> Column:
    """(term, times) of each word of a text, from its sorted words; no shuffle."""

    def per_run(words: Column) -> Column:
        begins = F.filter(F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i)), lambda i: i.isNotNull())
        return F.transform(
            F.array(begins),
            lambda b: F.transform(b, lambda i, n: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get(b, n + 1), F.size(words)) - i).alias("tf"))),
        )[0]

    return F.transform(F.array(F.sort_array(tokens(col))), per_run)[0]


def _weights(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length / mean))


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length / mean))


def _steps(batch: pa.RecordBatch):
    """The batch in parts of one block, or less if its documents have many terms."""
    block = np.asarray(batch.column(0)) >> BLOCK_BITS
    upto = np.cumsum(sum(np.asarray(pc.list_value_length(batch.column(c))).astype(np.int64) for c in (2, 4)))
    first = 0
    while first < len(batch):
        before = upto[first - 1] if first else 0
        stop = min(np.searchsorted(upto, before + STEP_TERMS, "right"), first + np.argmax(np.append(block[first:] != block[first], True)))
        stop = max(int(stop), first + 1)
        yield batch.slice(first, stop - first)
        first = stop


def _in_blocks(batches):
    """Documents, as they lie in a task, to one row per (term, field, block).

    The documents of a block stand together; where a batch ends inside one, or
    its documents have very many terms, its terms have a row for each part.  A
    task holds the postings of one part at a time, however many documents come
    in a batch.
    """
    for batch in (part for whole in batches for part in _steps(whole)):
        doc, at = np.asarray(batch.column(0)), batch.column(1)
        terms, columns = [], []
        for field in (0, 1):
            counts, lengths = batch.column(2 + 2 * field), np.asarray(batch.column(3 + 2 * field))
            flat, place = counts.flatten(), np.repeat(np.arange(len(batch)), np.asarray(counts.value_lengths()))
            terms.append(flat.field("term"))
            columns.append((np.full(len(place), field), place, np.asarray(flat.field("tf")), lengths[place]))
        coded = pa.concat_arrays(terms).dictionary_encode()
        code = np.asarray(coded.indices, np.int64)
        if not len(code):
            continue
        field, place, tf, length = (np.concatenate(c) for c in zip(*columns))
        block = doc[place] >> BLOCK_BITS
        # Stable, so entries stay in order of documents.
        order = np.lexsort((block, field, code))
        code, field, place, tf, length, block = (x[order] for x in (code, field, place, tf, length, block))
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (field[1:] != field[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(new)
        offsets = np.append(starts, len(code)).astype(np.int32)
        dates = np.asarray(pc.fill_null(at, NO_DATE))[place]
        parts = [pa.array(doc[place]), pa.array(tf, pa.int32()), pa.array(length, pa.int32()), at.take(pa.array(place))]
        entries = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["doc", "tf", "len", "at"]))
        yield pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(code[starts])), pa.array(field[starts], pa.int32()), pa.array(block[starts]), pa.array(np.diff(offsets).astype(np.int64)),
                pa.array(np.maximum.reduceat(tf, starts), pa.int32()), pa.array(np.minimum.reduceat(length, starts), pa.int32()), pa.array(np.maximum.reduceat(dates, starts)), entries,
            ],
            names=["term", "field", "block", "n", "max_tf", "min_len", "max_at", "entries"],
        )


def _in_files(rows: DataFrame) -> bool:
    """Whether these are rows of one table in as many files as there are cores: spread already, and as they were written."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return leaves.size() == 1 and len(rows.inputFiles()) >= rows.sparkSession.sparkContext.defaultParallelism


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _to_store(batches):
    """The postings of ``_in_blocks`` as they are stored, with places in the block for documents; sorted, so that a task only merges blocks."""
    for batch in _in_blocks(batches):
        coded = batch.column(0).dictionary_encode()
        code, place = np.asarray(coded.indices), np.empty(len(coded.dictionary), np.int64)
        place[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(place))
        buckets = np.array([zlib.crc32(t.encode()) % BUCKETS for t in coded.dictionary.to_pylist()])[code]
        order = np.lexsort((np.asarray(batch.column(1)), place[code], buckets))
        buckets, batch = buckets[order], batch.take(pa.array(order))
        rows = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        flat, offsets = rows["entries"].flatten(), np.concatenate([[0], np.cumsum(np.asarray(rows["n"]))])
        places = pa.array(np.asarray(flat.field("doc")) & ((1 << BLOCK_BITS) - 1), pa.int16())
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int32()), *(rows[name] for name in ("term", "field", "block", "n", "max_tf", "min_len", "max_at")), _lists(places, offsets), _lists(flat.field("tf"), offsets)],
            names=["bucket", "term", "field", "block", "n", "max_tf", "min_len", "max_at", "places", "times"],
        )


def _best_parts(total: np.ndarray, scores: np.ndarray, ids: pa.Array, parents: pa.Array):
    """(query, part, score, hits) of the best part of each document per query; at equal scores the first id.

    ``total`` and ``scores`` have a row per query and a column per part; a hit
    is a part with a total above 0.
    """
    document = np.asarray(pc.coalesce(parents, ids).dictionary_encode().indices)
    by_id = np.asarray(pc.sort_indices(ids))
    order = by_id[np.argsort(document[by_id], kind="stable")]
    starts = np.flatnonzero(np.diff(document[order], prepend=-1))
    live = total[:, order] > 0
    here = np.where(live, scores[:, order], -1.0)
    best = np.maximum.reduceat(here, starts, axis=1)
    first = np.where(live & (here == np.repeat(best, np.diff(np.append(starts, len(order))), axis=1)), np.arange(len(order)), len(order))
    first = np.minimum.reduceat(first, starts, axis=1)
    hits = np.add.reduceat(live.astype(np.int64), starts, axis=1)
    who, group = np.nonzero(hits)
    return who, order[first[who, group]], best[who, group], hits[who, group]


class InvertedIndex:
    """The index stored under ``path``; ``create`` starts an empty one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None) -> InvertedIndex:
        index = cls(spark, path or fresh_path(spark, "inverted"))
        spark.createDataFrame([], MANIFEST).write.parquet(f"{index.path}/manifest")
        return index

    # -- batches -----------------------------------------------------------------

    def batches(self) -> list[tuple[int, str]]:
        """(number, folder) of the batches in use: the last base and what came after it."""
        rows = sorted(tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect())
        base = max((r[2] for r in rows), default=0)
        return [(n, folder) for n, folder, _ in rows if n >= base]

    def table(self, name: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{folder}/{name}") for _, folder in self.batches()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def append(self, rows: DataFrame, text: str = "content", title: str = "title", only: DataFrame | None = None) -> None:
        """Add documents (id, text, title and, if there, updated_ms and parent_doc_id); an id that is there already is replaced.

        ``only`` (term) leaves out the postings of all other terms, for an
        index that serves one search.
        """
        at = F.col("updated_ms") if "updated_ms" in rows.columns else F.lit(None)
        parent = F.col("parent_doc_id") if "parent_doc_id" in rows.columns else F.lit(None)
        spread = rows.select("id", parent.cast("string").alias("parent_doc_id"), at.cast("long").alias("at"), F.col(text).alias("t0"), F.col(title).alias("t1"))
        if not _in_files(rows):
            spread = spread_small(spread, F.coalesce("parent_doc_id", "id"))
        self._add(spread.select("id", "parent_doc_id", "at", counted(F.col("t0")).alias("c0"), counted(F.col("t1")).alias("c1")), only)

    def compact(self) -> None:
        """All living documents in one new base; earlier batches are no longer read."""
        living = self.living("id", "parent_doc_id", "at", "c0", "c1")
        if living is not None:
            self._add(living, None, base=True)

    def living(self, *columns: str) -> DataFrame | None:
        docs = self.table("forward")
        if docs is None:
            return None
        dead = self.table("dead").select("doc")
        if dead.isEmpty():
            return docs.select(*columns)
        gone = in_blocks(dead)
        if gone.count() > BROADCAST_BLOCKS:
            return docs.join(dead, "doc", "left_anti").select(*columns)
        marked = docs.withColumn("block", block_of(F.col("doc"))).join(F.broadcast(gone), "block", "left")
        return marked.where(~F.coalesce(F.array_contains("gone", place_of(F.col("doc"))), F.lit(False))).select(*columns)

    def _add(self, counts: DataFrame, only: DataFrame | None, base: bool = False) -> None:
        earlier = self.batches()
        number = earlier[-1][0] + 1 if earlier else 0
        if number >= 1 << (63 - BATCH_BITS):
            raise ValueError("no batch number left: start a new index")
        folder = f"{self.path}/batch-{uuid.uuid4().hex}"
        doc = F.lit(number << BATCH_BITS) + F.monotonically_increasing_id()
        length = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["tf"])
        numbered = counts.select(doc.alias("doc"), "id", "parent_doc_id", "at", "c0", "c1", length("c0").alias("n0"), length("c1").alias("n1"))
        numbered.write.option("compression", "zstd").parquet(f"{folder}/forward")
        new = self.spark.read.parquet(f"{folder}/forward")
        self._write_dead(new, bool(earlier) and not base, folder)

        rows, group = new.select("doc", "at", "c0", "n0", "c1", "n1"), F.shiftright("block", GROUP_BITS)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if only is None:
            dealt = rows.mapInArrow(_to_store, STORED)
        else:
            asked = rows.mapInArrow(_in_blocks, POSTINGS).join(only.select("term").distinct(), "term", "left_semi")
            numbers = [F.transform("entries", lambda e: place_of(e["doc"])).alias("places"), F.col("entries.tf").alias("times")]
            dealt = asked.select(bucket(F.col("term")).alias("bucket"), "term", "field", "block", "n", "max_tf", "min_len", "max_at", *numbers).repartition(parts, "bucket", group)
        dealt.sortWithinPartitions("bucket", "term", "field", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
        self.spark.createDataFrame([(number, folder, number if base else 0)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write_dead(self, new: DataFrame, replaces: bool, folder: str) -> None:
        docs = self.living("doc", "id", "n0", "n1") if replaces else None
        gone = new.select("doc", "n0", "n1").limit(0) if docs is None else docs.join(new.select("id").distinct(), "id", "left_semi").drop("id")
        gone.write.parquet(f"{folder}/dead")
        lengths = [rows.select(F.lit(f).alias("field"), F.col(f"n{f}").alias("len"), F.lit(sign).alias("sign")) for f in (0, 1) for rows, sign in ((new, 1), (self.spark.read.parquet(f"{folder}/dead"), -1))]
        all_lengths = lengths[0].unionByName(lengths[1]).unionByName(lengths[2]).unionByName(lengths[3]).where("len > 0")
        all_lengths.groupBy("field").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("len")).alias("total")).coalesce(1).write.parquet(f"{folder}/stats")

    # -- search ------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int | None = None, as_of_ms: int | None = None, names: DataFrame | None = None, parts: bool = False) -> DataFrame:
        """(qid, id, score): best of the text score and three times the title score.

        With ``names`` (id and other columns) the hits of these documents get
        those columns in place of the id; names come to the document numbers
        first, so that the hits are joined once.

        With ``parts`` the hits are (qid, id, parent_doc_id, score, n_chunks,
        whole), where of a document with all its parts in one block, ``whole``,
        only the best part is left, with the number of its parts hit; other
        documents have such a row for each of their blocks.

        With ``k`` only the best of each query (ties at the cut go by id); with
        ``as_of_ms`` scores take the weight of the document's last update.
        Queries go in blocks; the driver holds the terms of one block.
        """
        if parts and (k is not None or names is not None):
            raise ValueError("parts go without k and names")
        schema = f"qid {queries.schema['qid'].dataType.simpleString()}, {BEST if parts else 'doc long, score double'}"
        wanted = materialize(query_terms(queries), "terms")
        ids = self.table("forward")
        blocks = max(1, -(-wanted.select("qid").distinct().count() // QUERY_BLOCK))
        path, found = fresh_path(self.spark, "hits"), None
        for b in range(blocks if ids is not None else 0):
            part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
            found = self._search_block(part, k, as_of_ms, schema, parts)
            if found is not None and blocks > 1:
                found.write.mode("append").parquet(path)
        if parts:
            schema += ", whole boolean"
            if blocks > 1 and found is not None:
                return self.spark.read.schema(schema).parquet(path)
            return self.spark.createDataFrame([], schema) if found is None else found
        if found is None and blocks == 1:
            none = self.spark.createDataFrame([], f"{schema}").select("qid", F.lit("").alias("id"), "score").limit(0)
            return none if names is None else none.join(names, "id").drop("id")
        if blocks > 1:
            found = self.spark.read.schema(schema).parquet(path)
        if names is not None and k is None:
            return found.join(ids.select("doc", "id").join(names, "id").drop("id"), "doc").drop("doc")
        hits = found.join(ids.select("doc", "id"), "doc").select("qid", "id", "score")
        if k is None:
            return hits
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        best = hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
        return best if names is None else best.join(names, "id").drop("id")

    def _search_block(self, wanted: DataFrame, k: int | None, as_of_ms: int | None, schema: str, parts: bool = False) -> DataFrame | None:
        terms = wanted.select("term").distinct()
        asked = [r[0] for r in terms.select(bucket(F.col("term")).alias("b")).distinct().collect()]
        postings = self.table("postings").where(F.col("bucket").isin(asked)).join(F.broadcast(terms), "term", "left_semi")
        heads = materialize(postings.select("term", "field", "block", "n", "max_tf", "min_len", "max_at"), "heads")
        stats = {r[0]: (r[1], r[2] / r[1]) for r in self.table("stats").groupBy("field").agg(F.sum("n"), F.sum("total")).collect() if r[1]}
        dead = self.table("dead")
        lost = postings.select("term", "field", "block", "places").join(in_blocks(dead), "block").select("term", "field", (-F.size(F.array_intersect("places", "gone"))).cast("long").alias("n"))
        changes = heads.select("term", "field", "n").unionByName(lost)
        counts = changes.groupBy("term", "field").agg(F.sum("n").alias("df")).where("df > 0")
        n = F.create_map(*[F.lit(x) for f, (m, _) in stats.items() for x in (f, float(m))])[F.col("field")]
        mean = F.create_map(*[F.lit(x) for f, (_, m) in stats.items() for x in (f, float(m))])[F.col("field")]
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        if not stats:
            return None
        factors = materialize(counts.withColumn("factor", idf).join(wanted, "term").select("qid", "term", "field", (F.col("factor") * F.col("times")).alias("factor")), "factors")

        scorer = self._scorer(factors.collect(), {f: m for f, (_, m) in stats.items()}, k, as_of_ms, parts)
        best = F.when(F.col("max_tf") > 0, _weight(F.col("max_tf"), F.col("min_len"), mean))
        latest = R.decay(F.nullif("max_at", F.lit(NO_DATE)), as_of_ms) if as_of_ms is not None else F.lit(1.0)
        per_field = heads.join(F.broadcast(factors), ["term", "field"]).groupBy("qid", "block").agg(
            F.sum(F.when(F.col("field") == 0, best * F.col("factor"))).alias("b0"), F.sum(F.when(F.col("field") == 1, best * F.col("factor"))).alias("b1"), F.max(latest).alias("late")
        )
        bound = F.greatest(F.coalesce("b0", F.lit(0.0)), F.lit(R.TITLE_BOOST) * F.coalesce("b1", F.lit(0.0))) * F.col("late")
        # A little more, so that rounding never makes a bound too low.
        pairs = per_field.select("qid", "block", (bound * (1 + 1e-9) + 2.0 / GRID).alias("bound"))
        if parts:
            return self._score_parts(postings, dead, pairs, scorer, schema)
        if k is None:
            return self._score(postings, dead, pairs, scorer, schema)
        first = max(1, -(-4 * k >> BLOCK_BITS))
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
        placed = materialize(pairs.withColumn("place", F.row_number().over(order)), "bounds")
        head = materialize(self._score(postings, dead, placed.where(F.col("place") <= first), scorer, schema), "first-hits")
        kth = head.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("r") == k).select("qid", F.col("score").alias("least"))
        rest = placed.where(F.col("place") > first).join(kth, "qid", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        return head.unionByName(self._score(postings, dead, rest, scorer, schema))

    def _score_parts(self, postings: DataFrame, dead: DataFrame, pairs: DataFrame, scorer, schema: str) -> DataFrame:
        """Score (query, block) pairs twice: for documents with all parts in one block, and the few entries of the others."""
        document = F.coalesce("parent_doc_id", "id")
        docs = self.table("forward").select("doc", "id", "parent_doc_id", "n0", "n1", "at", document.alias("document"))
        spans = docs.groupBy("document").agg(F.min(block_of(F.col("doc"))).alias("first"), F.max(block_of(F.col("doc"))).alias("last"))
        apart = materialize(spans.where("first < last").select("document"), "apart")
        whole, cut = docs.join(apart, "document", "left_anti"), materialize(docs.join(apart, "document", "left_semi"), "cut")
        once = self._score(postings, dead, pairs, scorer, schema, whole).withColumn("whole", F.lit(True))
        if cut.isEmpty():
            return once
        places = in_blocks(cut).withColumnRenamed("gone", "cut")
        places = F.broadcast(places) if places.count() <= BROADCAST_BLOCKS else places
        kept = F.filter(F.arrays_zip("places", "times"), lambda e: F.array_contains("cut", e["places"]))
        few = postings.join(places, "block").withColumn("kept", kept).where(F.size("kept") > 0).withColumns({"places": F.col("kept.places"), "times": F.col("kept.times")})
        return once.unionByName(self._score(few, dead, pairs, scorer, schema, cut).withColumn("whole", F.lit(False)))

    def _score(self, postings: DataFrame, dead: DataFrame, pairs: DataFrame, scorer, schema: str, named: DataFrame | None = None) -> DataFrame:
        """Score (query, block) pairs: entries and queries of a block meet in one task.

        Only documents of ``named`` are scored, if given, and bring their names.
        """
        none = lambda kind: F.lit(None).cast(kind)
        here = [block_of(F.col("doc")).alias("block"), F.array(place_of(F.col("doc"))).alias("places"), none("array<int>").alias("times")]
        gone = dead.select(none("string").alias("term"), F.lit(DEAD).alias("field"), *here, none("int").alias("n0"), none("int").alias("n1"), none("long").alias("at"))
        names = [] if named is None else ["id", "parent_doc_id"]
        docs = (self.table("forward") if named is None else named).select(none("string").alias("term"), F.lit(DOCUMENT).alias("field"), *here, "n0", "n1", "at", *names)
        rows = postings.select("term", "field", "block", "places", "times", none("int").alias("n0"), none("int").alias("n1"), none("long").alias("at"))
        rows = rows.unionByName(gone).unionByName(docs, allowMissingColumns=True)
        asked = pairs.select("qid", "block")
        return rows.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(scorer, schema)

    def _scorer(self, factors, means: dict[int, float], k: int | None, as_of_ms: int | None, parts: bool = False):
        qids = sorted({r["qid"] for r in factors})
        place = {q: i for i, q in enumerate(qids)}
        by_term: dict[tuple[int, str], list[tuple[int, float]]] = {}
        for r in factors:
            by_term.setdefault((r["field"], r["term"]), []).append((place[r["qid"]], r["factor"]))
        shared = self.spark.sparkContext.broadcast((qids, {key: (np.array([p for p, _ in v]), np.array([f for _, f in v])) for key, v in by_term.items()}))

        def score(key, entries: pa.Table, asked: pa.Table) -> pa.Table:
            qids, table = shared.value

            def hits(who, **columns) -> pa.Table:
                return pa.table({"qid": asked["qid"].combine_chunks().take(pa.array(who, pa.int64())), **columns})

            def no_hits() -> pa.Table:
                texts = {"id": pa.array([], pa.string()), "parent_doc_id": pa.array([], pa.string())}
                none, scores = pa.array([], pa.int64()), pa.array([], pa.float64())
                return hits([], **texts, score=scores, n_chunks=none) if parts else hits([], doc=none, score=scores)

            if not len(asked) or not len(entries):
                return no_hits()
            here = {q: i for i, q in enumerate(asked["qid"].to_pylist())}
            local = np.full(len(qids), -1)
            for i, q in enumerate(qids):
                local[i] = here.get(q, -1)
            size, base = 1 << BLOCK_BITS, key[0].as_py() << BLOCK_BITS
            sums = np.zeros((2, len(here), size))
            alive, at = np.zeros(size, bool), np.full(size, np.nan)
            entries = entries.combine_chunks()
            fields = np.asarray(entries["field"])
            places = entries["places"].combine_chunks()
            offsets = np.concatenate([[0], np.cumsum(np.asarray(places.value_lengths()))])
            place = np.asarray(places.flatten())
            info = np.flatnonzero(fields == DOCUMENT)
            # a document's row and a dead one's have one place
            where, lengths = place[offsets[info]], np.ones((2, size))
            alive[where] = True
            alive[place[offsets[np.flatnonzero(fields == DEAD)]]] = False
            of_docs = entries.take(pa.array(info))
            lengths[0, where], lengths[1, where] = (np.asarray(of_docs[c], np.float64) for c in ("n0", "n1"))
            at[where] = of_docs["at"].to_numpy().astype(np.float64)
            terms = np.flatnonzero(fields >= 0)
            named = entries.take(pa.array(terms))
            times, upto = np.asarray(named["times"].combine_chunks().flatten(), np.float64), 0
            starts = {}
            for row, n in zip(terms.tolist(), (offsets[terms + 1] - offsets[terms]).tolist()):
                starts[row] = slice(upto, upto + n)
                upto += n
            names = dict(zip(terms.tolist(), zip(fields[terms].tolist(), named["term"].to_pylist())))
            for row in sorted(names, key=names.get):
                wanted = table.get(names[row])
                if wanted is None:
                    continue
                field, doc = names[row][0], place[offsets[row] : offsets[row + 1]]
                who, factors = local[wanted[0]], wanted[1]
                weight = _weights(times[starts[row]], lengths[field, doc], means[field])
                sums[field][who[who >= 0, None], doc] += factors[who >= 0, None] * weight
            total = np.maximum(sums[0], R.TITLE_BOOST * sums[1])
            total[:, ~alive] = 0
            scores = np.floor(total * GRID + 0.5) / GRID
            if as_of_ms is not None:
                age = np.maximum(0, as_of_ms - at - R.DECAY_OFFSET_MS)
                weight = np.where(np.isnan(at), 1.0, np.power(0.5, age / R.DECAY_SCALE_MS)) * R.DECAY_WEIGHT
                scores = np.floor(scores * weight * GRID + 0.5) / GRID
            if parts:
                if not len(info):
                    return no_hits()
                ids, parents = of_docs["id"].combine_chunks(), of_docs["parent_doc_id"].combine_chunks()
                who, part, best, n = _best_parts(total[:, where], scores[:, where], ids, parents)
                taken = pa.array(part)
                return hits(who, id=ids.take(taken), parent_doc_id=parents.take(taken), score=best, n_chunks=n)
            out = []
            for q in range(len(here)):
                hit = np.flatnonzero(total[q] > 0)
                if k is not None and len(hit) > k:
                    # every tie at the cut goes on; the final cut orders them by id
                    hit = hit[scores[q, hit] >= np.partition(scores[q, hit], len(hit) - k)[len(hit) - k]]
                out.append((np.full(len(hit), q), hit))
            who, docs = (np.concatenate(x) for x in zip(*out))
            return hits(who, doc=docs + base, score=scores[who, docs])

        return score

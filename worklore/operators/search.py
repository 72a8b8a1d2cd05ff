"""Retrieval and ranking over an index table, for a whole table of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklore.functions import ranking as R
from worklore.functions import text as T
from worklore.operators.inverted import GRID, InvertedIndex, query_terms, steady
from worklore.session import fresh_path, materialize

# Fixed values.
ALL_SOURCES = ["jira", "slack", "gmail", "drive", "confluence", "calendar"]
TYPES_OF_SOURCE = {
    "issue": ["jira"], "comment": ["jira", "confluence"], "message": ["slack"], "thread_reply": ["slack"],
    "email": ["gmail"], "document": ["drive"], "spreadsheet": ["drive"], "presentation": ["drive"],
    "pdf": ["drive"], "other": ["drive"], "page": ["confluence"], "blogpost": ["confluence"], "event": ["calendar"],
}
DEFAULT_LIMIT = 20
BY_METADATA_LIMIT = 50
QUERY_BLOCK = 1024
TASK_CUT, CUT_PARTS = 1000, 64


# -- filters -------------------------------------------------------------------


def filters(df: DataFrame, sources=None, where: dict | None = None, start: str | None = None, end: str | None = None, ts: str = "created_ms") -> DataFrame:
    """Source list (only 1 to 5 of the 6 restrict), equality, creation range.

    Values that are not scalar are passed over, as are times that do not parse.
    """
    if sources and len(sources) < len(ALL_SOURCES):
        df = df.filter(F.col("source").isin(list(sources)))
    for key, value in (where or {}).items():
        if isinstance(value, (str, int, float, bool)):
            df = df.filter(F.col(key) == F.lit(value))
    for text, from_below in ((start, True), (f"{end} 23:59:59.999" if end else None, False)):
        if text:
            bound = F.unix_millis(F.try_to_timestamp(F.lit(text)))
            keep = (F.col(ts) >= bound) if from_below else (F.col(ts) <= bound)
            df = df.filter(bound.isNull() | F.coalesce(keep, F.lit(False)))
    return df


# -- keyword score -------------------------------------------------------------


def bm25(index: DataFrame, queries: DataFrame, text: str = "content", title: str = "title", k: int | None = None, as_of_ms: int | None = None) -> DataFrame:
    """(qid, id, score): best of the text score and three times the title score; the best ``k`` per query if given.

    With ``as_of_ms`` scores take the weight of the last update.  Rows that have
    no stored inverted index get one with the asked terms only.
    """
    made = InvertedIndex.create(index.sparkSession)
    made.append(index, text, title, only=materialize(query_terms(queries).select("term").distinct(), "terms"))
    return made.search(queries, k, as_of_ms)


# -- vector score --------------------------------------------------------------


def top_per_query(hits: DataFrame, k: int, per: str = "qid") -> DataFrame:
    """Best ``k`` per query; cut in each task first, then after the shuffle.

    Spark cuts in the tasks for small ``k`` only; beyond that a query's hits are
    first dealt out and cut in parts, so they never meet in one task whole.
    """
    if k > TASK_CUT:
        part = F.pmod(F.xxhash64("id"), F.lit(CUT_PARTS))
        in_part = Window.partitionBy(per, "_part").orderBy(F.desc("score"), "id")
        hits = hits.withColumn("_part", part).withColumn("_rn", F.row_number().over(in_part)).filter(F.col("_rn") <= k).drop("_part", "_rn")
    w = Window.partitionBy(per).orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _score_block(vectors: DataFrame, qids: list, matrix: np.ndarray, k: int, id_type: str, qid_type: str) -> DataFrame:
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            rows = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            size = np.linalg.norm(rows, axis=1)
            ids, rows = batch["id"].to_numpy()[size > 0], rows[size > 0] / size[size > 0, None]
            if not len(ids):
                continue
            sims = np.floor((1.0 + unit @ rows.T) / 2.0 * GRID + 0.5) / GRID
            for q, sim in zip(qids, sims):
                # every tie at the cut goes on; the final cut orders them by id
                floor = np.partition(sim, -k)[-k] if len(sim) > k else -1.0
                best = sim >= floor
                yield pd.DataFrame({"qid": q, "id": ids[best], "score": sim[best]})

    return vectors.select("id", "embedding").mapInPandas(score, f"qid {qid_type}, id {id_type}, score double")


def knn(vectors: DataFrame, queries: DataFrame, k: int = R.VECTOR_K) -> DataFrame:
    """(qid, id, score, rank): exact cosine neighbours, score (1 + cos) / 2.

    The query vectors travel to the tasks in blocks of bounded size, one pass of
    matrix products over the vectors each, which keeps only its own best ``k``
    per Arrow batch.  With more than one block the driver holds one at a time:
    its result is stored before the next is fetched.
    """
    id_type, qid_type = (d.schema[c].dataType.simpleString() for d, c in ((vectors, "id"), (queries, "qid")))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = queries.select("qid", "embedding").withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    schema, spark = f"qid {qid_type}, id {id_type}, score double, rank int", vectors.sparkSession
    if blocks > 1:
        parts = materialize(parts, "query-vectors")
    path, out = fresh_path(spark, "nearest"), None
    for b in range(blocks):
        rows = parts.filter(F.col("_b") == b).collect()
        if rows:
            matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
            out = top_per_query(_score_block(vectors, [r["qid"] for r in rows], matrix, k, id_type, qid_type), k)
            if blocks > 1:
                out.write.mode("append").parquet(path)
    if out is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path) if blocks > 1 else out


def hybrid(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Sum of both scores over the union of both hit lists."""
    a = keyword.select("qid", "id", F.col("score").alias("_kw"))
    b = vector.select("qid", "id", F.col("score").alias("_vec"))
    zero = F.lit(0.0)
    return a.join(b, ["qid", "id"], "full_outer").select(
        "qid", "id", steady(F.coalesce("_kw", zero) + F.coalesce("_vec", zero)).alias("score")
    )


# -- ranking of hits -----------------------------------------------------------


def best_chunk(hits: DataFrame) -> DataFrame:
    """Best chunk per query and document, with the number of its chunks hit; the hits are shuffled once.

    Hits of an index's parts stand for ``n_chunks`` each, and those of a
    ``whole`` document are its best chunk already: they are not shuffled.
    """
    if "whole" in hits.columns:
        whole, rest = hits.filter("whole").drop("whole"), hits.filter(~F.col("whole")).drop("whole")
        return whole.unionByName(best_chunk(rest))
    group = Window.partitionBy("qid", "_doc")
    keyed = hits.withColumn("_doc", F.coalesce("parent_doc_id", "id"))
    n = F.sum("n_chunks") if "n_chunks" in hits.columns else F.count(F.lit(1))
    counted = keyed.withColumn("_rn", F.row_number().over(group.orderBy(F.desc("score"), "id"))).withColumn("n_chunks", n.over(group))
    return counted.filter(F.col("_rn") == 1).drop("_rn", "_doc")


def boosted(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", steady(R.multi_chunk(F.col("score"), F.col("n_chunks"))))


def rescored(hits: DataFrame, scores: DataFrame, keep: int, n: int = R.RESCORE_N) -> DataFrame:
    """First ``n`` hits per query take a given score, and the best ``keep`` of
    them stay, those without a given score last and with their own; the hits
    after the first ``n`` follow in their order.

    The hits are the fetched page of a query, a bounded number per query.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("_rank", F.row_number().over(w))
    joined = ranked.join(scores.select("qid", "id", F.col("score").alias("_new")), ["qid", "id"], "left")
    first = joined.filter(F.col("_rank") <= n).withColumn("score", F.coalesce("_new", "score"))
    again = Window.partitionBy("qid").orderBy(F.col("_new").isNull(), F.desc("_new"), "_rank")
    top = first.withColumn("position", F.row_number().over(again)).filter(F.col("position") <= keep)
    rest = joined.filter(F.col("_rank") > n).withColumn("position", F.col("_rank"))
    return top.unionByName(rest).drop("_rank", "_new")


def personalize(hits: DataFrame, as_of_ms: int, at: Column | None = None) -> DataFrame:
    """Weighted by recency, ownership, engagement and relevance of the row."""
    c = F.col
    when = at if at is not None else F.coalesce("updated_at", "other_at")
    engaged = R.engagement(
        c("source"), c("reaction_count"), c("mention_count"), c("thread_ts"), c("priority_weight"), c("thread_depth"), c("label_count")
    )
    mine = [F.coalesce(c(name), F.lit(False)) for name in ("is_owner", "is_organizer", "is_author") if name in hits.columns]
    owner = reduce(lambda a, b: a | b, mine, F.lit(False))
    score = R.personalised(
        c("score"), R.recency(c("source"), when, as_of_ms), R.ownership(owner, c("is_assigned_to_me")), engaged, c("relevance_score")
    )
    return hits.withColumn("score", steady(score))


def search(
    index: DataFrame,
    queries: DataFrame,
    as_of_ms: int,
    mode: str = "hybrid",
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    rescore: DataFrame | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    inverted: InvertedIndex | None = None,
    **where,
) -> DataFrame:
    """The whole search: filter, retrieve, de-duplicate, boost, rescore,
    personalise, sort and page, for every query at once.

    An empty source list does not restrict the sources.  ``inverted`` is the
    stored index of the same rows; with filters, term statistics are those of
    the filtered rows, which get an index of the asked terms.  Keyword search
    alone takes only the page from it; with vectors all its hits are summed.
    """
    whole, index = index, filters(index, **where)
    fetch = limit + offset
    if mode in ("keyword", "hybrid"):
        if inverted is None or index is not whole:
            hits = bm25(index, queries, k=fetch if mode == "keyword" else None, as_of_ms=as_of_ms)
        else:
            hits = inverted.search(queries, fetch if mode == "keyword" else None, as_of_ms)
    if mode in ("vector", "hybrid"):
        near = knn(vectors.join(index.select("id"), "id", "left_semi"), query_vectors).select("qid", "id", "score")
        hits = near if mode == "vector" else hybrid(hits, near)
    page = materialize(top_per_query(hits, fetch).drop("rank"), "page")
    found = boosted(best_chunk(page.join(index.drop("score", "content", "embedding"), "id")))
    if rescore is not None:
        found = rescored(found, rescore, fetch)
    final = personalize(found, as_of_ms)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = final.withColumn("position", F.row_number().over(w)).withColumn(
        "total", F.count(F.lit(1)).over(Window.partitionBy("qid"))
    )
    return ranked.filter((F.col("position") > offset) & (F.col("position") <= offset + limit))


# -- browsing ------------------------------------------------------------------


def list_docs(index: DataFrame, source: str, limit: int = DEFAULT_LIMIT, offset: int = 0, collapse: bool = False, **where) -> DataFrame:
    """A page of one source, newest first, without chunk rows.

    ``collapse`` also shows chunked documents, by their first chunk.
    """
    rows = filters(index.filter(F.col("source") == source), **where)
    rows = rows.filter(F.col("parent_doc_id").isNull() | (F.col("chunk_index") == 0 if collapse else F.lit(False)))
    order = [F.desc_nulls_last("updated_ms"), F.desc_nulls_last("created_ms"), F.asc("id")]
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def browse(index: DataFrame, sources: list[str], limit: int = DEFAULT_LIMIT, offset: int = 0, **where) -> DataFrame:
    """Several sources in one list: the first rows of each, merged by date."""
    rows = filters(index.filter(F.col("source").isin(sources)), **where).filter(F.col("parent_doc_id").isNull())
    total = rows.agg(F.count(F.lit(1))).scalar()
    per_source = Window.partitionBy("source").orderBy(F.desc_nulls_last("updated_ms"), F.desc_nulls_last("created_ms"), "id")
    head = rows.withColumn("_rn", F.row_number().over(per_source)).filter(F.col("_rn") <= limit + offset)
    # zero counts as missing, as does null
    key = F.coalesce(F.nullif("updated_ms", F.lit(0)), F.nullif("created_ms", F.lit(0)), F.lit(0))
    return head.orderBy(key.desc(), "id").offset(offset).limit(limit).drop("_rn").withColumn("total", total)


def doc_stats(index: DataFrame) -> DataFrame:
    """Rows and distinct documents per source, with a total line (source null)."""
    per_doc = index.groupBy("source", F.coalesce("parent_doc_id", "id").alias("_doc")).agg(F.count(F.lit(1)).alias("_n"))
    return per_doc.rollup("source").agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_documents"))


def get_docs(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows by id; the stored copy of the text if there is one."""
    return index.join(ids.select("id").distinct(), "id", "left_semi").withColumn("text", T.first_set(F.col("original"), F.col("indexed")))


def by_metadata(index: DataFrame, source: str, where: dict, limit: int = BY_METADATA_LIMIT) -> DataFrame:
    rows = filters(index.filter(F.col("source") == source), where=where)
    return rows.orderBy("id").limit(limit)


def present(results: DataFrame, mode: str, page_size: int = DEFAULT_LIMIT) -> DataFrame:
    """Result page order: ``date``, ``source`` or ``relevance``; percent score."""
    order = {
        "date": [F.desc_nulls_last(F.coalesce("updated_at", "other_at")), F.asc("id")],
        "source": [F.asc("source"), F.desc("score"), F.asc("id")],
        "relevance": [F.desc("score"), F.asc("id")],
    }[mode]
    w = Window.partitionBy("qid").orderBy(*order)
    return results.select(
        "*",
        F.row_number().over(w).alias("place"),
        F.round(F.col("score") * 100).cast("long").alias("percent"),
        F.ceil(F.count(F.lit(1)).over(Window.partitionBy("qid")) / F.lit(page_size)).cast("long").alias("n_pages"),
    )


def type_source(df: DataFrame, type_col: str = "type") -> DataFrame:
    """Whether a document type can come from the row's source."""
    pairs = [x for t, ss in TYPES_OF_SOURCE.items() for x in (F.lit(t), F.array(*[F.lit(s) for s in ss]))]
    allowed = F.try_element_at(F.create_map(*pairs), F.col(type_col))
    return df.withColumn("valid", F.coalesce(F.array_contains(allowed, F.col("source")), F.lit(False)))


def navigate(items: DataFrame, wanted: DataFrame, direction: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Children by parent, or siblings in the same thread, of the wanted ids.

    A group is cut to its first rows before the join: one more than asked for,
    as an item is not its own sibling.  So no thread is paired with itself.
    """
    group = "parent_id" if direction == "children" else "thread"
    ids = wanted.select("id").distinct()
    if direction == "children":
        home = ids.select(F.col("id").alias("of_id"), F.col("id").alias(group))
    else:
        home = items.join(ids, "id", "left_semi").select(F.col("id").alias("of_id"), group)
    first = Window.partitionBy(group).orderBy("sort_key", "id")
    head = items.filter(F.col(group).isNotNull()).withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= limit + 1)
    pairs = head.join(home, group).filter(F.col("id") != F.col("of_id"))
    w = Window.partitionBy("of_id").orderBy("_rn")
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("_rn")


def deep_dive(hits: DataFrame, templates: DataFrame, queries: DataFrame) -> DataFrame:
    """Follow-up queries on the topic's text, only for the sources that had hits, per query."""
    found = hits.groupBy("qid", "source").agg(F.count(F.lit(1)).alias("n_hits"))
    asked = found.join(templates, "source").join(queries.select("qid", "query"), "qid")
    return asked.select("qid", "source", "n_hits", F.concat_ws(" ", "template", "query").alias("next_query"))

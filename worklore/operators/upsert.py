"""Incremental load: what changed, what to write, what to delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklore.operators.search import ALL_SOURCES
from worklore.operators.spread import numbered

# Fixed values.
EMBED_BATCH = 100
REUSE_MS = 300_000
QUERY_KEY_CHARS = 32


def changed(docs: DataFrame, hashes: DataFrame, force: bool = False) -> DataFrame:
    """Documents whose ``doc_hash`` is new or differs; ``force`` keeps all."""
    if force:
        return docs
    known = hashes.select("source", "id", F.col("hash").alias("_old"))
    return docs.join(known, ["source", "id"], "left").filter(~F.col("doc_hash").eqNullSafe(F.col("_old"))).drop("_old")


def route(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """``route``: ``meta`` where the stored text is the same, else ``full``."""
    stored = index.select("id", F.col("content_hash").alias("_stored"))
    same = (F.col("content_hash") == F.col("_stored")) & (F.col("_stored") != "")
    return chunks.join(stored, "id", "left").withColumn("route", F.when(same, "meta").otherwise("full")).drop("_stored")


def upsert(index: DataFrame, routed: DataFrame, kept: list[str], prune: bool = False) -> DataFrame:
    """The new index: full rows replace, metadata rows leave ``kept`` columns.

    ``kept`` are the columns a metadata-only row must not touch (text, vector).
    ``prune`` drops chunks that a re-loaded document no longer has.
    """
    cols = index.columns
    new = routed.select("id", "route", *[F.col(c).alias(f"_new_{c}") for c in cols if c != "id"])
    both = index.withColumn("_had", F.lit(True)).join(new, "id", "full_outer")

    def merged(name: str):
        fresh = F.col("route").isNotNull() & ~((F.col("route") == "meta") & F.lit(name in kept))
        return F.when(fresh, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    out = both.select("id", "route", *[merged(c) for c in cols if c != "id"])
    if prune:
        loaded = routed.select(F.coalesce("parent_doc_id", "id").alias("_doc")).distinct().withColumn("_re", F.lit(True))
        out = out.withColumn("_doc", F.coalesce("parent_doc_id", "id")).join(loaded, "_doc", "left")
        out = out.filter(F.col("route").isNotNull() | F.col("_re").isNull())
    return out.select(*cols)


def latest(df: DataFrame, seq: str, key: str = "id") -> DataFrame:
    """Last row per id inside a batch; cut in each task before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the documents and their chunks."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    rows = index.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    # Whole documents have no parent: they stay without taking part in the second join.
    chunks = rows.filter(F.col("parent_doc_id").isNotNull()).join(gone, F.col("parent_doc_id") == F.col("_gone"), "left_anti")
    return rows.filter(F.col("parent_doc_id").isNull()).unionByName(chunks)


def delete_source(index: DataFrame, source: str) -> DataFrame:
    return index.filter(F.col("source") != source)


def drop_hashes(hashes: DataFrame, ids: DataFrame) -> DataFrame:
    """Hashes of other documents: not the id itself, nor the id and ``_...``.

    Each hash key is looked up by its own prefixes that end before a ``_``, so
    the prefix test is an equi-join.
    """
    parts = F.split("id", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    probes = hashes.select("source", "id", F.explode(prefixes).alias("_prefix"))
    hit = probes.join(ids.select(F.col("id").alias("_prefix")), "_prefix", "left_semi").select("source", "id")
    return hashes.join(hit, ["source", "id"], "left_anti")


def bulk_delete(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row with the number deleted, one row per request that failed)."""
    valid = F.col("source").isin(ALL_SOURCES)
    deleted = requests.agg(F.count_if(valid).alias("deleted"))
    errors = requests.filter(~F.coalesce(valid, F.lit(False))).select(
        "id", F.concat(F.lit("Invalid source: "), F.coalesce("source", F.lit(""))).alias("error")
    )
    return deleted, errors


def advance(cursors: DataFrame, batches: DataFrame, as_of: str) -> DataFrame:
    """New cursor per source: with a page token the old time stays.

    ``batches`` is (source, last_item_at, sync_token, config_key).
    """
    now = F.lit(as_of).cast("timestamp")
    old = cursors.select("source", F.col("last_sync").alias("_old"))
    paging = F.coalesce("sync_token", F.lit("")) != ""
    keep = F.coalesce("_old", "last_item_at", now)
    return batches.join(old, "source", "left").select(
        "source", F.when(paging, keep).otherwise(F.coalesce("last_item_at", now)).alias("last_sync"), "sync_token", "config_key"
    )


def batch_last_sync(df: DataFrame, updated: str = "updated_at", start: str = "start") -> DataFrame:
    """Greatest update, or start, of the rows per source."""
    return df.groupBy("source").agg(F.max(F.coalesce(updated, start)).alias("last_item_at"))


def enabled(requested: DataFrame, disabled: DataFrame) -> DataFrame:
    """Requested sources that are known and not switched off."""
    known = requested.filter(F.col("source").isin(ALL_SOURCES))
    return known.join(disabled, "source", "left_anti").select("source").distinct()


def collect_all(parts: dict[str, DataFrame], disabled: list[str]) -> tuple[DataFrame | None, list[str], list[str]]:
    """(rows of all enabled sources, sources started, sources skipped)."""
    started = [s for s in parts if s not in disabled]
    skipped = [s for s in parts if s in disabled]
    rows = None
    for s in started:
        rows = parts[s] if rows is None else rows.unionByName(parts[s], allowMissingColumns=True)
    return rows, started, skipped


def embed_plan(routed: DataFrame, vectors: DataFrame, size: int = EMBED_BATCH) -> DataFrame:
    """Chunks that need a vector, in numbered batches.

    The order is by hash prefix, then id; no task has to see all rows to number them.
    """
    todo = routed.filter(F.col("route") == "full").join(vectors.select("content_hash"), "content_hash", "left_anti")
    rows = numbered(todo, [], [F.substring(F.sha2("id", 256), 1, 4), F.col("id")], "position")
    return rows.withColumn("batch", F.ceil(F.col("position") / size).cast("long"))


def query_key(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, QUERY_KEY_CHARS)


def reuse(queries: DataFrame, cache: DataFrame, as_of_ms: int) -> DataFrame:
    """Queries with the cached vector that is still valid, if there is one.

    ``cache`` is (key, stored_ms, ...); an entry lives five minutes.
    """
    live = cache.filter((F.col("stored_ms") <= as_of_ms) & (F.col("stored_ms") + REUSE_MS > as_of_ms))
    newest = live.groupBy("key").agg(F.max_by(F.struct(*[c for c in live.columns if c != "key"]), "stored_ms").alias("_hit")).select("key", "_hit.*")
    return queries.withColumn("key", query_key(F.col("query"))).join(newest.drop("stored_ms"), "key", "left")

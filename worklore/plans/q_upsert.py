"""Queries U01 to U15: incremental load, upsert, delete."""

from pyspark.sql import functions as F

from worklore.functions import text as T
from worklore.operators import chunks as C
from worklore.operators import upsert as U
from worklore.plans import raw as R
from worklore.plans.q_sources import c
from worklore.plans.q_search import index
from worklore.plans.registry import query
from worklore.plans.standins import CHECK_VIEWS, standin, table
from worklore.sources import issues, mail, meetings, wiki
from worklore.streaming import incremental as N

# The state before the load: some documents unknown, some with another text,
# some with the same text and other metadata.
OLD_TEXT = "CASE WHEN doc_id % 5 = 0 THEN 'old ' || content ELSE content END"


def old_docs(spark, sf):
    v = standin(spark, sf, "v_docs").filter(c("quality").isNull() | (c("quality") == 1))
    return v.withColumn("content", F.when(c("doc_id") % 5 == 0, F.concat(F.lit("old "), "content")).otherwise(c("content"))).withColumn(
        "title", F.when(c("doc_id") % 4 == 0, "old title").otherwise(c("title"))
    )


CHECK_VIEWS["c_old"] = f"SELECT * REPLACE ({OLD_TEXT} AS content, CASE WHEN doc_id % 4 = 0 THEN 'old title' ELSE title END AS title) FROM v_docs WHERE quality IS NULL OR quality = 1"
HASH_SQL = "sha256(content || chr(31) || title || chr(31) || source)"


def hashed(df):
    return df.withColumn("doc_hash", T.doc_hash(c("content"), c("title"), c("source")))


@query(
    "u01_changed",
    f"""SELECT d.id, d.source FROM v_docs d LEFT JOIN (SELECT id, {HASH_SQL} AS h FROM c_old) o ON d.id = o.id
        WHERE o.h IS DISTINCT FROM sha256(d.content || chr(31) || d.title || chr(31) || d.source)""",
)
def u01(spark, sf):
    hashes = hashed(old_docs(spark, sf)).select("source", "id", c("doc_hash").alias("hash"))
    return U.changed(hashed(standin(spark, sf, "v_docs")), hashes).select("id", "source")


# Chunks of whole lines, so that the check can make them too.
LINES_SQL = """(SELECT CASE WHEN n > 1 THEN id || '_chunk_' || i ELSE id END AS id, CASE WHEN n > 1 THEN id END AS parent_doc_id, line AS chunk, title, source
  FROM (SELECT id, title, source, len(p) AS n, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS line
        FROM (SELECT id, title, source, string_split(source || chr(10) || content, chr(10)) AS p FROM {docs})))"""
CHECK_VIEWS["c_new_rows"] = f"SELECT *, substring(sha256(chunk), 1, 16) AS h FROM {LINES_SQL.format(docs='v_docs')}"
CHECK_VIEWS["c_old_rows"] = f"SELECT *, substring(sha256(chunk), 1, 16) AS h FROM {LINES_SQL.format(docs='c_old')}"
CHECK_VIEWS["c_routed"] = "SELECT n.*, CASE WHEN o.h = n.h THEN 'meta' ELSE 'full' END AS route FROM c_new_rows n LEFT JOIN c_old_rows o ON n.id = o.id"


def line_rows(docs):
    lines = docs.withColumn("lines", F.split(F.concat_ws("\n", "source", "content"), "\n"))
    rows = C.explode_chunks(lines, ready="lines").withColumn("content_hash", T.content_hash(c("chunk")))
    return rows.select("id", "parent_doc_id", "chunk", "title", "source", "content_hash")


def routed(spark, sf):
    old, new = line_rows(old_docs(spark, sf)), line_rows(standin(spark, sf, "v_docs"))
    return old, U.route(new, old)


@query("u02_route", "SELECT id, route FROM c_routed")
def u02(spark, sf):
    return routed(spark, sf)[1].select("id", "route")


UPSERT_SQL = """SELECT coalesce(r.id, o.id) AS id, md5(CASE WHEN r.route = 'full' THEN r.chunk ELSE o.chunk END) AS chunk_hash,
       coalesce(r.title, o.title) AS title, coalesce(r.source, o.source) AS source FROM c_old_rows o FULL JOIN c_routed r ON o.id = r.id"""


@query("u03_upsert", UPSERT_SQL)
def u03(spark, sf):
    old, new = routed(spark, sf)
    return U.upsert(old, new, kept=["chunk"]).select("id", F.md5("chunk").alias("chunk_hash"), "title", "source")


@query(
    "u03_upsert_prune",
    UPSERT_SQL + " WHERE r.id IS NOT NULL OR coalesce(o.parent_doc_id, o.id) NOT IN (SELECT coalesce(parent_doc_id, id) FROM c_routed)",
)
def u03_prune(spark, sf):
    old, new = routed(spark, sf)
    return U.upsert(old, new, kept=["chunk"], prune=True).select("id", F.md5("chunk").alias("chunk_hash"), "title", "source")


@query("u04_latest", "SELECT text AS id, max(doc_id) AS seq FROM documents GROUP BY text")
def u04(spark, sf):
    docs = table(spark, sf, "documents").select(c("text").alias("id"), c("doc_id").alias("seq"))
    return U.latest(docs, "seq")


def bench_ids(spark, sf, prefix="doc_"):
    return table(spark, sf, "benchmark").select(F.concat(F.lit(prefix), "item_id").alias("id"))


@query(
    "u05_delete",
    """SELECT id FROM c_index WHERE id NOT IN (SELECT 'doc_' || item_id FROM benchmark)
       AND coalesce(parent_doc_id, '') NOT IN (SELECT 'doc_' || item_id FROM benchmark)""",
)
def u05(spark, sf):
    return U.delete(index(spark, sf), bench_ids(spark, sf)).select("id")


@query("u06_delete_source", "SELECT id, source FROM c_index WHERE source <> 'slack'")
def u06(spark, sf):
    return U.delete_source(index(spark, sf), "slack").select("id", "source")


@query(
    "u07_drop_hashes",
    """SELECT source, id FROM c_index h WHERE NOT EXISTS (
         SELECT 1 FROM benchmark b WHERE h.id = 'doc_' || b.item_id OR starts_with(h.id, 'doc_' || b.item_id || '_'))""",
)
def u07(spark, sf):
    return U.drop_hashes(index(spark, sf).select("source", "id"), bench_ids(spark, sf)).select("source", "id")


@query(
    "u08_bulk_delete",
    """SELECT 'deleted' AS id, CAST(count(*) AS STRING) AS result FROM v_docs WHERE label_count <> 1
       UNION ALL SELECT id, 'Invalid source: ' || folder FROM v_docs WHERE label_count = 1""",
)
def u08(spark, sf):
    asked = standin(spark, sf, "v_docs").select("id", F.when(c("label_count") == 1, c("folder")).otherwise(c("source")).alias("source"))
    deleted, errors = U.bulk_delete(asked)
    return deleted.select(F.lit("deleted").alias("id"), c("deleted").cast("string").alias("result")).unionByName(
        errors.select("id", c("error").alias("result"))
    )


@query(
    "u09_cursor",
    """WITH b AS (SELECT source, max(created_at) AS last_item_at, CASE WHEN source IN ('jira', 'drive') THEN 'p' || count(*) END AS token FROM v_docs GROUP BY source)
       SELECT source, epoch_ms(CASE WHEN source = 'jira' THEN TIMESTAMP '2023-05-05 00:00:00' ELSE coalesce(last_item_at, TIMESTAMP '2024-01-31 00:00:00') END) AS last_ms, token, 'k' AS config_key FROM b""",
)
def u09(spark, sf):
    docs = standin(spark, sf, "v_docs")
    b = docs.groupBy("source").agg(F.max("created_at").alias("last_item_at"), F.count(F.lit(1)).alias("n"))
    b = b.select("source", "last_item_at", F.when(c("source").isin("jira", "drive"), F.concat(F.lit("p"), "n")).alias("sync_token"), F.lit("k").alias("config_key"))
    cursors = docs.filter(c("source").isin("jira", "gmail")).select("source").distinct().withColumn("last_sync", F.lit("2023-05-05").cast("timestamp"))
    return U.advance(cursors, b, "2024-01-31 00:00:00").select("source", T.epoch_ms(c("last_sync")).alias("last_ms"), c("sync_token").alias("token"), "config_key")


@query(
    "u10_last_sync",
    """SELECT 'calendar' AS source, epoch_ms(max(date_trunc('second', coalesce(updated_at, CASE WHEN all_day THEN date_trunc('day', start_at) ELSE start_at END)))) AS last_ms
       FROM v_meetings WHERE status <> 'cancelled'""",
)
def u10(spark, sf):
    d = meetings.calendar(R.raw_calendar(spark, sf))
    return U.batch_last_sync(d).select("source", T.epoch_ms(c("last_item_at")).alias("last_ms"))


@query(
    "u11_incremental",
    """SELECT id, title, md5(chunk) AS chunk_hash FROM (SELECT c.id, c.chunk, d.title FROM c_chunks c JOIN v_docs d ON c.doc = d.id)""",
)
def u11(spark, sf):
    """Two loads of the document table through the stream, the old state first."""
    return two_loads(spark, sf).compact(prune=True).select("id", "title", F.md5("chunk").alias("chunk_hash"))


def two_loads(spark, sf):
    cols = ["id", "source", "title", "content", "author", "created_at", "updated_at", "seq"]
    job = N.new_job(spark, hash_of=["content", "title", "source"])
    job.land(old_docs(spark, sf).withColumn("seq", F.lit(1)).select(*cols))
    job.run()
    job.land(standin(spark, sf, "v_docs").withColumn("seq", F.lit(2)).select(*cols))
    job.run()
    return job


@query("u11_cursors", "SELECT source, epoch_ms(max(updated_at)) AS cursor_ms FROM v_docs GROUP BY source")
def u11_cursors(spark, sf):
    """How far each source has been loaded after both loads."""
    return two_loads(spark, sf).cursors().select("source", F.unix_millis("cursor").alias("cursor_ms"))


@query(
    "u12_collect_all",
    """SELECT source, count(*) AS n, 'jira,gmail,calendar' AS started, 'confluence' AS skipped FROM (
         SELECT 'jira' AS source FROM v_issues UNION ALL SELECT 'gmail' FROM c_mail UNION ALL SELECT 'calendar' FROM v_meetings WHERE status <> 'cancelled') GROUP BY source""",
)
def u12(spark, sf):
    parts = {
        "jira": issues.issues(R.raw_issues(spark, sf)), "gmail": mail.emails(R.raw_mail(spark, sf)),
        "confluence": wiki.wiki_pages(R.raw_wiki(spark, sf)), "calendar": meetings.calendar(R.raw_calendar(spark, sf)),
    }
    rows, started, skipped = U.collect_all(parts, ["confluence"])
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        "source", "n", F.lit(",".join(started)).alias("started"), F.lit(",".join(skipped)).alias("skipped")
    )


@query(
    "u13_enabled",
    """SELECT source FROM (SELECT source FROM v_docs UNION SELECT folder FROM v_docs)
       WHERE source IN ('jira', 'slack', 'gmail', 'drive', 'confluence', 'calendar') EXCEPT SELECT source FROM v_docs WHERE doc_id % 6 IN (1, 3)""",
)
def u13(spark, sf):
    v = standin(spark, sf, "v_docs")
    asked = v.select("source").unionByName(v.select(c("folder").alias("source")))
    return U.enabled(asked, v.filter((c("doc_id") % 6).isin(1, 3)).select("source").distinct())


@query(
    "u14_embed_plan",
    """WITH todo AS (SELECT id, h FROM c_routed WHERE route = 'full' AND h NOT IN (SELECT h FROM c_old_rows)),
       p AS (SELECT id, h, row_number() OVER (ORDER BY substring(sha256(id), 1, 4), id) AS position FROM todo)
       SELECT id, position, CAST(ceil(position / 100.0) AS BIGINT) AS batch FROM p""",
)
def u14(spark, sf):
    old, new = routed(spark, sf)
    return U.embed_plan(new, old).select("id", "position", "batch")


@query(
    "u15_reuse",
    """WITH cache AS (SELECT substring(sha256(query), 1, 32) AS key, qid * 10000 AS stored_ms, topic FROM v_queries WHERE topic <> 3),
       live AS (SELECT * FROM cache WHERE stored_ms <= 350000 AND stored_ms + 300000 > 350000),
       newest AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY key ORDER BY stored_ms DESC) = 1)
       SELECT qid, substring(sha256(query), 1, 32) AS key, n.topic AS cached_topic FROM v_queries q LEFT JOIN newest n ON n.key = substring(sha256(query), 1, 32)""",
)
def u15(spark, sf):
    q = standin(spark, sf, "v_queries")
    cache = q.filter(c("topic") != 3).select(U.query_key(c("query")).alias("key"), (c("qid") * 10000).alias("stored_ms"), c("topic").alias("cached_topic"))
    return U.reuse(q, cache, 350000).select("qid", "key", "cached_topic")



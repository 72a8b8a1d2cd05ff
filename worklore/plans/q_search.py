"""Queries Q01 to Q21: search, ranking, browsing."""

from pyspark.sql import functions as F

from worklore.functions import ranking as R
from worklore.functions import text as T
from worklore.operators import chunks as C
from worklore.operators import search as S
from worklore.operators.inverted import InvertedIndex
from worklore.plans import checks as K
from worklore.plans.registry import query
from worklore.plans.standins import standin, table
from worklore.session import materialize

AS_OF = K.AS_OF_MS


def r6(c):
    return F.round(c, 6)


def ranked_docs(spark, sf):
    docs = standin(spark, sf, "v_ranked_docs")
    return docs.select("*", T.epoch_ms(F.col("created_at")).alias("created_ms"), T.epoch_ms(F.col("updated_at")).alias("updated_ms"))


def index(spark, sf):
    """The index table of all documents: built, written, and read by column.

    A chunk is stored once; its copy and its text with the title are made of it when they are read.
    """
    rows = (
        C.explode_chunks(ranked_docs(spark, sf))
        .withColumn("content", F.col("chunk"))
        .withColumn("content_hash", T.content_hash(F.col("chunk")))
        .drop("chunk")
    )
    return (
        materialize(rows, "index")
        .withColumn("original", T.original(F.col("content")))
        .withColumn("indexed", F.concat(F.lit("Document: "), "title", F.lit("\n\n"), "content"))
    )


#: Tables with their stored inverted index, by application, tables and builder: made by the first query that needs them.
STORED = {}


def stored(spark, sf, rows_of=index):
    """(rows, their inverted index), stored once for all searches of a session."""
    key = (spark.sparkContext.applicationId, sf, rows_of.__name__)
    if key not in STORED:
        rows = rows_of(spark, sf)
        made = InvertedIndex.create(spark)
        made.append(rows)
        STORED[key] = rows, made
    return STORED[key]


def vectors(spark, sf):
    return standin(spark, sf, "v_vectors")


def topic_vectors(spark, sf):
    """The mean vector of each topic, over all vectors of it."""
    parts = vectors(spark, sf).select("topic", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("topic", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding")
    )


def query_vectors(spark, sf):
    """Every query takes the mean vector of its topic."""
    q = standin(spark, sf, "v_queries").select("qid", "topic")
    return q.join(topic_vectors(spark, sf), "topic").select("qid", "embedding")


@query(
    "q01_filters",
    """SELECT id, source, lang, created_ms FROM c_index
       WHERE source IN ('jira', 'drive') AND lang = 'en' AND created_ms >= epoch_ms(TIMESTAMP '2023-01-02 00:00:00')
         AND created_ms <= epoch_ms(TIMESTAMP '2023-12-31 23:59:59.999')""",
)
def q01(spark, sf):
    out = S.filters(index(spark, sf), ["jira", "drive"], {"lang": "en", "folder": ["not", "scalar"]}, "2023-01-02", "2023-12-31")
    return out.select("id", "source", "lang", "created_ms")


@query("q02_bm25", f"WITH {K.bm25_sql('v_docs', 'content')} SELECT qid, id, round(score, 6) AS score FROM scored")
def q02(spark, sf):
    _, inverted = stored(spark, sf, ranked_docs)
    return inverted.search(standin(spark, sf, "v_queries")).select("qid", "id", r6(F.col("score")).alias("score"))


TOP_SQL = "SELECT qid, id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 25"


@query("q02_bm25_top", f"WITH {K.bm25_sql('v_docs', 'content')} {TOP_SQL}")
def q02_top(spark, sf):
    """The best 25 of each query: blocks whose bound is below the 25th score are not read."""
    _, inverted = stored(spark, sf, ranked_docs)
    return inverted.search(standin(spark, sf, "v_queries"), 25).select("qid", "id", r6(F.col("score")).alias("score"))


@query("q02_index_batches", f"WITH {K.bm25_sql('v_docs', 'content')} {TOP_SQL}")
def q02_batches(spark, sf):
    """An index loaded in batches, its first with old texts, the later ones replacing them source by source."""
    docs = standin(spark, sf, "v_docs")
    made = InvertedIndex.create(spark)
    made.append(docs.withColumn("content", F.concat("title", F.lit(" "), "lang", F.lit(" "), "content")))
    early = F.col("source").isin("jira", "slack", "gmail")
    made.append(docs.where(early))
    made.append(docs.where(~early))
    made.compact()
    return made.search(standin(spark, sf, "v_queries"), 25).select("qid", "id", r6(F.col("score")).alias("score"))


@query(
    "q02_index_size",
    f"""WITH t AS (SELECT id, 0 AS field, regexp_extract_all(lower(chunk), '{K.TOKEN_SQL}') AS w FROM c_index
              UNION ALL SELECT id, 1, regexp_extract_all(lower(title), '{K.TOKEN_SQL}') FROM c_index)
        SELECT CAST(field AS INT) AS field, count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words, CAST(sum(len(list_distinct(w))) AS BIGINT) AS n_entries
        FROM t WHERE len(w) > 0 GROUP BY field""",
)
def q02_size(spark, sf):
    """What the stored index holds; the query that pays for building it anew."""
    made = InvertedIndex.create(spark)
    made.append(index(spark, sf))
    entries = made.table("postings").groupBy("field").agg(F.sum("n").alias("n_entries"))
    return made.table("stats").join(entries, "field").select("field", F.col("n").alias("n_docs"), F.col("total").cast("long").alias("n_words"), "n_entries")


@query("q03_decay", f"SELECT id, round({K.DECAY_SQL}, 6) AS factor FROM (SELECT id, epoch_ms(updated_at) AS updated_ms FROM v_docs)")
def q03(spark, sf):
    return ranked_docs(spark, sf).select("id", r6(R.decay(F.col("updated_ms"), AS_OF)).alias("factor"))


@query(
    "q04_knn",
    f"WITH {K.KNN_SQL} SELECT CAST(qtopic AS INT) AS qid, id, round(score, 6) AS score FROM near",
)
def q04(spark, sf):
    qv = topic_vectors(spark, sf).select(F.col("topic").alias("qid"), "embedding")
    return S.knn(vectors(spark, sf), qv).select("qid", "id", r6(F.col("score")).alias("score"))


@query(
    "q05_hybrid",
    f"""WITH {K.bm25_sql('v_docs', 'content')}, {K.KNN_SQL},
        merged AS (SELECT s.qid, s.id, (floor((s.score * {K.DECAY_SQL}) * 1073741824 + 0.5) / 1073741824) AS score FROM scored s
                   JOIN (SELECT id, epoch_ms(updated_at) AS updated_ms FROM v_docs) d ON s.id = d.id
                 UNION ALL SELECT q.qid, n.id, n.score FROM near n JOIN v_queries q ON q.topic = n.qtopic)
        SELECT qid, id, round((floor((sum(score)) * 1073741824 + 0.5) / 1073741824), 6) AS score FROM merged GROUP BY qid, id""",
)
def q05(spark, sf):
    _, inverted = stored(spark, sf, ranked_docs)
    kw = inverted.search(standin(spark, sf, "v_queries"), as_of_ms=AS_OF)
    return S.hybrid(kw, S.knn(vectors(spark, sf), query_vectors(spark, sf))).select("qid", "id", r6(F.col("score")).alias("score"))


CHUNK_HITS = f"{K.bm25_sql('c_index', 'chunk')}"
JOINED = """joined AS (SELECT s.qid, s.id, s.score, i.parent_doc_id,
     count(*) OVER (PARTITION BY s.qid, coalesce(i.parent_doc_id, s.id)) AS n_chunks FROM scored s JOIN c_index i ON s.id = i.id)"""


def chunk_hits(spark, sf):
    _, inverted = stored(spark, sf)
    return inverted.search(standin(spark, sf, "v_queries"), parts=True)


@query(
    "q06_best_chunk",
    f"""WITH {CHUNK_HITS}, {JOINED} SELECT qid, id, parent_doc_id, round(score, 6) AS score FROM joined
        QUALIFY row_number() OVER (PARTITION BY qid, coalesce(parent_doc_id, id) ORDER BY score DESC, id) = 1""",
)
def q06(spark, sf):
    return S.best_chunk(chunk_hits(spark, sf)).select("qid", "id", "parent_doc_id", r6(F.col("score")).alias("score"))


@query(
    "q07_boost",
    f"""WITH {CHUNK_HITS}, {JOINED} SELECT qid, id, n_chunks,
            round(floor((CASE WHEN n_chunks > 1 THEN score * (1 + least(0.05 * ln(n_chunks), 0.15)) ELSE score END) * 1073741824 + 0.5) / 1073741824, 6) AS score FROM joined
        QUALIFY row_number() OVER (PARTITION BY qid, coalesce(parent_doc_id, id) ORDER BY joined.score DESC, id) = 1""",
)
def q07(spark, sf):
    return S.boosted(S.best_chunk(chunk_hits(spark, sf))).select("qid", "id", "n_chunks", r6(F.col("score")).alias("score"))


def given_scores(hits, keep_all=True):
    """A stand-in for the second-stage model: a score from the hash of the id."""
    return hits.select("qid", "id", (F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("double") / 16777216).alias("score"))


@query(
    "q08_rescore",
    f"""WITH {K.KNN_SQL}, hits AS (SELECT q.qid, n.id, n.score FROM near n JOIN v_queries q ON q.topic = n.qtopic),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk,
                     CAST('0x' || substring(md5(id), 1, 6) AS BIGINT) / 16777216.0 AS given FROM hits),
        top AS (SELECT qid, id, given AS score, row_number() OVER (PARTITION BY qid ORDER BY given DESC, rk) AS position
                FROM r WHERE rk <= 120 QUALIFY position <= 20)
        SELECT qid, id, round(score, 6) AS score, position FROM top
        UNION ALL SELECT qid, id, round(score, 6), rk FROM r WHERE rk > 120""",
)
def q08(spark, sf):
    hits = S.knn(vectors(spark, sf), query_vectors(spark, sf)).drop("rank")
    out = S.rescored(hits, given_scores(hits), keep=20, n=120)
    return out.select("qid", "id", r6(F.col("score")).alias("score"), F.col("position").cast("long").alias("position"))


@query(
    "q08_rescore_partial",
    f"""WITH {K.KNN_SQL}, hits AS (SELECT q.qid, n.id, n.score FROM near n JOIN v_queries q ON q.topic = n.qtopic),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk,
                     CASE WHEN substring(md5(id), 7, 1) < '9' THEN CAST('0x' || substring(md5(id), 1, 6) AS BIGINT) / 16777216.0 END AS given FROM hits)
        SELECT qid, id, round(coalesce(given, score), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY given DESC NULLS LAST, rk) AS position
        FROM r WHERE rk <= 120 QUALIFY position <= 110
        UNION ALL SELECT qid, id, round(score, 6), rk FROM r WHERE rk > 120""",
)
def q08_partial(spark, sf):
    """Some hits have no given score: they stay, after those that have one."""
    hits = S.knn(vectors(spark, sf), query_vectors(spark, sf)).drop("rank")
    given = given_scores(hits).where(F.substring(F.md5("id"), 7, 1) < "9")
    out = S.rescored(hits, given, keep=110, n=120)
    return out.select("qid", "id", r6(F.col("score")).alias("score"), F.col("position").cast("long").alias("position"))


@query(
    "q09_half_life",
    """SELECT source, count(*) AS n, CAST(max(CASE source WHEN 'slack' THEN 7 WHEN 'calendar' THEN 14 WHEN 'gmail' THEN 14 WHEN 'jira' THEN 30
              WHEN 'confluence' THEN 90 WHEN 'drive' THEN 90 ELSE 30 END) AS INT) AS half_life
       FROM (SELECT source FROM v_docs UNION ALL SELECT folder FROM v_docs) GROUP BY source""",
)
def q09(spark, sf):
    docs = standin(spark, sf, "v_docs")
    both = docs.select("source").unionByName(docs.select(F.col("folder").alias("source")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max(R.half_life(F.col("source"))).alias("half_life"))


@query(
    "q10_engagement",
    """SELECT id, round(CASE source WHEN 'slack' THEN least(1.0, reaction_count * 0.1 + mention_count * 0.15 + CASE WHEN thread_ts IS NOT NULL THEN 0.2 ELSE 0 END)
              WHEN 'jira' THEN least(1.0, priority_weight / 5.0)
              WHEN 'gmail' THEN CASE WHEN thread_depth > 3 THEN 0.6 WHEN thread_depth > 1 THEN 0.3 ELSE 0 END
              WHEN 'confluence' THEN least(1.0, label_count * 0.15) ELSE 0 END, 6) AS engagement FROM v_ranked_docs""",
)
def q10(spark, sf):
    c = F.col
    e = R.engagement(c("source"), c("reaction_count"), c("mention_count"), c("thread_ts"), c("priority_weight"), c("thread_depth"), c("label_count"))
    return standin(spark, sf, "v_ranked_docs").select("id", r6(e).alias("engagement"))


@query(
    "q11_personalised",
    f"SELECT id, round(floor(((1 + label_count) * {K.PERSONAL_SQL}) * 1073741824 + 0.5) / 1073741824, 6) AS score FROM v_ranked_docs",
)
def q11(spark, sf):
    hits = ranked_docs(spark, sf).withColumn("score", (1 + F.col("label_count")).cast("double"))
    return S.personalize(hits, AS_OF).select("id", r6(F.col("score")).alias("score"))


FINAL = "SELECT qid, id, source, n_chunks, round(score, 6) AS score, position, total FROM final_page"


def page_of(df):
    long = lambda c: F.col(c).cast("long").alias(c)
    return df.select("qid", "id", "source", "n_chunks", r6(F.col("score")).alias("score"), long("position"), long("total"))


@query(
    "q12_search_keyword",
    f"""WITH {CHUNK_HITS}, kw AS (SELECT s.qid, s.id, (floor((s.score * {K.DECAY_SQL}) * 1073741824 + 0.5) / 1073741824) AS score FROM scored s JOIN c_index i ON s.id = i.id),
        {K.pipeline_sql('kw', 20, 5)} {FINAL} WHERE position > 5 AND position <= 25""",
)
def q12_keyword(spark, sf):
    rows, inverted = stored(spark, sf)
    return page_of(S.search(rows, standin(spark, sf, "v_queries"), AS_OF, "keyword", limit=20, offset=5, inverted=inverted))


@query(
    "q12_search_vector",
    f"""WITH {K.KNN_SQL}, vec AS (SELECT q.qid, i.id, n.score FROM near n JOIN v_queries q ON q.topic = n.qtopic JOIN c_index i ON i.id = n.id),
        {K.pipeline_sql('vec', 20)} {FINAL} WHERE position <= 20""".replace("FROM v_vectors v, centres c", "FROM v_vectors v, centres c WHERE v.id IN (SELECT id FROM c_index)"),
)
def q12_vector(spark, sf):
    out = S.search(index(spark, sf), standin(spark, sf, "v_queries"), AS_OF, "vector", vectors(spark, sf), query_vectors(spark, sf))
    return page_of(out)


@query(
    "q12_search_hybrid",
    f"""WITH {CHUNK_HITS}, {K.KNN_SQL.replace("FROM v_vectors v, centres c", "FROM v_vectors v, centres c WHERE v.id IN (SELECT id FROM c_index WHERE source IN ('jira', 'gmail', 'calendar'))")},
        summed AS (SELECT qid, id, (floor((sum(score)) * 1073741824 + 0.5) / 1073741824) AS score FROM (
            SELECT s.qid, s.id, (floor((s.score * {K.DECAY_SQL}) * 1073741824 + 0.5) / 1073741824) AS score FROM scored s JOIN c_index i ON s.id = i.id
            UNION ALL SELECT q.qid, n.id, n.score FROM near n JOIN v_queries q ON q.topic = n.qtopic) GROUP BY qid, id),
        {K.pipeline_sql('summed', 10)} {FINAL} WHERE position <= 10""".replace("FROM c_index UNION ALL", "FROM c_index WHERE source IN ('jira', 'gmail', 'calendar') UNION ALL")
    .replace("AS t FROM c_index\n", "AS t FROM c_index WHERE source IN ('jira', 'gmail', 'calendar')\n")
    .replace("'[\\p{L}\\p{N}]+') FROM c_index)", "'[\\p{L}\\p{N}]+') FROM c_index WHERE source IN ('jira', 'gmail', 'calendar'))"),
)
def q12_hybrid(spark, sf):
    out = S.search(
        index(spark, sf), standin(spark, sf, "v_queries"), AS_OF, "hybrid", vectors(spark, sf), query_vectors(spark, sf),
        limit=10, sources=["jira", "gmail", "calendar"],
    )
    return page_of(out)


@query(
    "q13_list",
    """SELECT id, updated_ms, created_ms, (SELECT count(*) FROM c_index WHERE source = 'jira' AND parent_doc_id IS NULL) AS total
       FROM c_index WHERE source = 'jira' AND parent_doc_id IS NULL
       ORDER BY updated_ms DESC NULLS LAST, created_ms DESC NULLS LAST, id LIMIT 20 OFFSET 10""",
)
def q13(spark, sf):
    return S.list_docs(index(spark, sf), "jira", offset=10).select("id", "updated_ms", "created_ms", "total")


@query(
    "q14_browse",
    """WITH r AS (SELECT * FROM c_index WHERE source IN ('jira', 'drive', 'slack') AND parent_doc_id IS NULL),
       h AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY updated_ms DESC NULLS LAST, created_ms DESC NULLS LAST, id) <= 25)
       SELECT id, source, (SELECT count(*) FROM r) AS total FROM h
       ORDER BY coalesce(nullif(updated_ms, 0), nullif(created_ms, 0), 0) DESC, id LIMIT 20 OFFSET 5""",
)
def q14(spark, sf):
    return S.browse(index(spark, sf), ["jira", "drive", "slack"], offset=5).select("id", "source", "total")


@query(
    "q15_stats",
    """SELECT source, count(*) AS n_rows, count(DISTINCT coalesce(parent_doc_id, id)) AS n_documents FROM c_index GROUP BY ROLLUP (source)""",
)
def q15(spark, sf):
    return S.doc_stats(index(spark, sf))


@query(
    "q16_get",
    """SELECT id, md5(substring(chunk, 1, 8000)) AS h FROM c_index WHERE id IN (SELECT 'doc_' || item_id FROM benchmark)""",
)
def q16(spark, sf):
    ids = table(spark, sf, "benchmark").select(F.concat(F.lit("doc_"), "item_id").alias("id"))
    return S.get_docs(index(spark, sf), ids).select("id", F.md5("text").alias("h"))


@query("q17_by_metadata", "SELECT id, lang FROM c_index WHERE source = 'confluence' AND lang = 'de' AND label_count = 1 ORDER BY id LIMIT 50")
def q17(spark, sf):
    return S.by_metadata(index(spark, sf), "confluence", {"lang": "de", "label_count": 1}).select("id", "lang")


@query(
    "q18_present",
    f"""WITH {K.KNN_SQL}, h AS (SELECT CAST(qtopic AS INT) AS qid, n.id, n.score, d.updated_at, d.other_at, d.source FROM near n JOIN v_docs d ON n.id = d.id)
        SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY coalesce(updated_at, other_at) DESC NULLS LAST, id) AS INT) AS by_date,
               CAST(row_number() OVER (PARTITION BY qid ORDER BY source, score DESC, id) AS INT) AS by_source,
               CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS by_relevance,
               CAST(round(score * 100) AS BIGINT) AS percent, CAST(ceil(count(*) OVER (PARTITION BY qid) / 20.0) AS BIGINT) AS n_pages FROM h""",
)
def q18(spark, sf):
    qv = topic_vectors(spark, sf).select(F.col("topic").alias("qid"), "embedding")
    hits = S.knn(vectors(spark, sf), qv).join(standin(spark, sf, "v_docs").select("id", "updated_at", "other_at", "source"), "id")
    out = hits
    for mode in ("date", "source", "relevance"):
        out = S.present(out.drop("percent", "n_pages"), mode).withColumnRenamed("place", f"by_{mode}")
    return out.select("qid", "id", "by_date", "by_source", "by_relevance", "percent", "n_pages")


@query(
    "q19_type_source",
    """SELECT source, kind AS type, count(*) AS n,
              CASE kind WHEN 'page' THEN source = 'confluence' WHEN 'comment' THEN source IN ('jira', 'confluence')
                        WHEN 'email' THEN source = 'gmail' WHEN 'pdf' THEN source = 'drive' ELSE FALSE END AS valid
       FROM (SELECT source, CASE label_count WHEN 0 THEN 'comment' WHEN 1 THEN CASE lang WHEN 'en' THEN 'page' WHEN 'de' THEN 'email' ELSE 'pdf' END ELSE 'memo' END AS kind FROM v_docs)
       GROUP BY ALL""",
)
def q19(spark, sf):
    kind = F.when(F.col("label_count") == 0, "comment").when(
        F.col("label_count") == 1, F.when(F.col("lang") == "en", "page").when(F.col("lang") == "de", "email").otherwise("pdf")
    ).otherwise("memo")
    rows = S.type_source(standin(spark, sf, "v_docs").select("source", kind.alias("type")))
    return rows.groupBy("source", "type", "valid").agg(F.count(F.lit(1)).alias("n"))


def messages_as_items(spark, sf):
    m = standin(spark, sf, "v_messages")
    starter = F.concat(F.lit("slack_"), "channel_id", F.lit("_"), "thread_ts")
    return m.select(
        F.concat(F.lit("slack_"), "channel_id", F.lit("_"), "ts").alias("id"),
        F.when(F.col("thread_ts").isNotNull(), starter).alias("parent_id"),
        F.coalesce("thread_ts", "ts").alias("thread"), F.col("ts").alias("sort_key"), "turn",
    )


ITEMS_SQL = """items AS (SELECT 'slack_' || channel_id || '_' || ts AS id, 'slack_' || channel_id || '_' || thread_ts AS parent_id,
        coalesce(thread_ts, ts) AS thread, ts AS sort_key, turn FROM v_messages)"""


@query(
    "q20_children",
    f"""WITH {ITEMS_SQL} SELECT w.id AS of_id, i.id, CAST(row_number() OVER (PARTITION BY w.id ORDER BY i.sort_key, i.id) AS INT) AS place
        FROM items i JOIN items w ON i.parent_id = w.id QUALIFY place <= 3""",
)
def q20_children(spark, sf):
    items = messages_as_items(spark, sf)
    return S.navigate(items, items.select("id"), "children", 3).select("of_id", "id", "place")


@query(
    "q20_siblings",
    f"""WITH {ITEMS_SQL} SELECT w.id AS of_id, i.id, CAST(row_number() OVER (PARTITION BY w.id ORDER BY i.sort_key, i.id) AS INT) AS place
        FROM items i JOIN items w ON i.thread = w.thread AND i.id <> w.id QUALIFY place <= 4""",
)
def q20_siblings(spark, sf):
    items = messages_as_items(spark, sf)
    return S.navigate(items, items.select("id"), "siblings", 4).select("of_id", "id", "place")


@query(
    "q21_deep_dive",
    f"""WITH {K.bm25_sql('v_docs', 'content')}, h AS (SELECT s.qid, d.source, count(*) AS n_hits FROM scored s JOIN v_docs d ON s.id = d.id GROUP BY ALL)
        SELECT qid, h.source, n_hits, template || ' ' || query AS next_query FROM h JOIN v_queries USING (qid)
        JOIN (SELECT DISTINCT source, 'more on ' || source AS template FROM v_docs) t ON h.source = t.source""",
)
def q21(spark, sf):
    docs = standin(spark, sf, "v_docs")
    queries = standin(spark, sf, "v_queries")
    _, inverted = stored(spark, sf, ranked_docs)
    hits = inverted.search(queries, names=docs.select("id", "source"))
    templates = docs.select("source", F.concat(F.lit("more on "), "source").alias("template")).distinct()
    return S.deep_dive(hits, templates, queries)

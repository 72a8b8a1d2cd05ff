"""Queries T01 to T17: text preparation and chunking."""

from pyspark.sql import functions as F

from worklore.functions import text as T
from worklore.operators import chunks as C
from worklore.plans import checks  # noqa: F401  (adds the check views)
from worklore.plans.registry import query
from worklore.plans.standins import standin, table
from worklore.session import spread_small


@query(
    "t01_sanitize",
    r"""SELECT doc_id, md5('{"t":"' || replace(replace(lang, '"', ''), '\', '') || source || '\ud83d\ude00\\n\\u"}') AS clean_hash
        FROM documents""",
)
def t01(spark, sf):
    raw = F.concat(F.lit('{"t":"'), "lang", F.lit(r"\ud800"), "source", F.lit(r"\udc00\ud83d\ude00\\n\\u"), F.lit('"}'))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.sanitize_json(raw)).alias("clean_hash"))


@query("t02_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INT) AS n_tokens FROM documents")
def t02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.n_tokens(F.col("text")).alias("n_tokens"))


@query(
    "t03_sentences",
    f"""SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS pos, md5(unnest(p)) AS sentence_hash FROM (
        SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE [text] END AS p FROM (
        SELECT doc_id, text, list_filter(regexp_extract_all(text, '{T.SENTENCE}'),
               lambda x: regexp_matches(x, '{T.NOT_SPACE}')) AS p FROM documents))""",
)
def t03(spark, sf):
    docs = spread_small(table(spark, sf, "documents"), "doc_id")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s")).select(
        "doc_id", "pos", F.md5("s").alias("sentence_hash")
    )


@query("t04_chunks", "SELECT doc, CAST(coalesce(chunk_index, 0) AS INT) AS pos, md5(chunk) AS chunk_hash, length(chunk) AS n_chars FROM c_chunks")
def t04(spark, sf):
    docs = spread_small(standin(spark, sf, "v_docs"), "id")
    return docs.select(F.col("id").alias("doc"), F.posexplode(T.chunks(F.col("content"))).alias("pos", "c")).select(
        "doc", "pos", F.md5("c").alias("chunk_hash"), F.length("c").cast("long").alias("n_chars")
    )


@query("t05_file_chunks")
def t05(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return C.chunk_files(docs, body="text").select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), "chunk")


@query("t06_code_chunks")
def t06(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("page"), "page_id", F.lit(".html")).alias("name"), "html")
    return C.code_chunks(pages, body="html").select("page_id", "language", "chunk_index", "chunk")


@query(
    "t07_language",
    """SELECT file_id, CASE lower(regexp_extract(name, '[^/.][^/]*\\.([^./]+)$', 1))
              WHEN 'py' THEN 'python' WHEN 'ts' THEN 'js' WHEN 'md' THEN 'markdown' WHEN 'kt' THEN 'java'
              WHEN 'html' THEN 'html' END AS language,
              lower(regexp_extract(name, '[^/.][^/]*\\.([^./]+)$', 1)) IN ('py', 'ts', 'md', 'kt', 'html') AS is_code
       FROM v_files""",
)
def t07(spark, sf):
    return standin(spark, sf, "v_files").select(
        "file_id", T.language(F.col("name")).alias("language"), T.is_code(F.col("name")).alias("is_code")
    )


@query(
    "t08_explode",
    """SELECT id, parent_doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(total_chunks AS INT) AS total_chunks,
              md5(chunk) AS chunk_hash FROM c_chunks""",
)
def t08(spark, sf):
    return C.explode_chunks(standin(spark, sf, "v_docs")).select(
        "id", "parent_doc_id", "chunk_index", "total_chunks", F.md5("chunk").alias("chunk_hash")
    )


@query(
    "t08_explode_ready",
    """SELECT CASE WHEN n > 1 THEN id || '_chunk_' || i ELSE id END AS id, CASE WHEN n > 1 THEN id END AS parent_doc_id,
              CASE WHEN n > 1 THEN i END AS chunk_index, md5(line) AS chunk_hash
       FROM (SELECT id, len(p) AS n, CAST(generate_subscripts(p, 1) - 1 AS INT) AS i, unnest(p) AS line
             FROM (SELECT id, string_split(title || chr(10) || content, chr(10)) AS p FROM v_docs))""",
)
def t08_ready(spark, sf):
    docs = standin(spark, sf, "v_docs").withColumn("lines", F.split(F.concat_ws("\n", "title", "content"), "\n"))
    return C.explode_chunks(docs, ready="lines").select("id", "parent_doc_id", "chunk_index", F.md5("chunk").alias("chunk_hash"))


@query(
    "t09_header",
    """SELECT id, md5('Document: ' || title || chr(10) || 'Source: ' || source
              || CASE WHEN source = 'jira' THEN chr(10) || 'Project: ' || folder || chr(10) || 'Status: Open'
                      WHEN source = 'slack' THEN chr(10) || 'Channel: #' || folder || chr(10) || 'Author: ' || author
                      WHEN source = 'gmail' THEN chr(10) || 'From: ' || author
                      WHEN source = 'drive' THEN chr(10) || 'Path: ' || folder || chr(10) || 'Type: text/plain'
                      WHEN source = 'confluence' THEN chr(10) || 'Space: ' || folder || chr(10) || '(page comment)'
                      ELSE chr(10) || 'Location: ' || folder END
              || coalesce(chr(10) || 'Date: ' || strftime(coalesce(created_at, updated_at), '%Y-%m-%d'), '')
              || chr(10) || chr(10) || chunk) AS indexed_hash
       FROM (SELECT c.id, c.chunk, d.title, d.source, d.folder, d.author, d.created_at, d.updated_at
             FROM c_chunks c JOIN v_docs d ON c.doc = d.id)""",
)
def t09(spark, sf):
    docs = standin(spark, sf, "v_docs").select(
        "id", "content", "source", "title", "author", "created_at", "updated_at",
        F.col("folder").alias("project"), F.lit("Open").alias("status"), F.col("folder").alias("channel"),
        F.col("author").alias("sender"), F.col("folder").alias("folder_path"), F.lit("text/plain").alias("mime_type"),
        F.col("folder").alias("space"), F.lit("comment").alias("type"), F.col("folder").alias("location"),
    )
    return C.with_header(C.explode_chunks(docs)).select("id", F.md5("indexed").alias("indexed_hash"))


@query(
    "t10_flatten",
    """SELECT id, epoch_ms(created_at) AS created_ms, CASE WHEN doc_id % 8 <> 0 THEN epoch_ms(updated_at) END AS updated_ms,
              '{"source":"' || source || '"' || CASE WHEN doc_id % 3 = 0 THEN ',"lang":"' || lang || '"' ELSE '' END
              || ',"label_count":' || CAST(label_count AS STRING) || ',"refs":["' || folder || '","' || lang || '"]}' AS metadata_json
       FROM v_docs""",
)
def t10(spark, sf):
    docs = standin(spark, sf, "v_docs").select(
        "id", "source", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"), "label_count",
        F.array("folder", "lang").alias("refs"), F.col("created_at").cast("string").alias("created_at"),
        F.when(F.col("doc_id") % 8 == 0, "soon").otherwise(F.col("updated_at").cast("string")).alias("updated_at"),
    )
    return C.flatten_meta(docs, ["source", "lang", "label_count", "refs"]).select("id", "created_ms", "updated_ms", "metadata_json")


@query("t11_content_hash", "SELECT id, content_hash FROM c_chunks")
def t11(spark, sf):
    return C.explode_chunks(standin(spark, sf, "v_docs")).select("id", T.content_hash(F.col("chunk")).alias("content_hash"))


@query(
    "t12_doc_hash",
    """SELECT id, sha256(content || chr(31) || title || chr(31) || source || chr(31) || coalesce(CAST(quality AS STRING), chr(30))) AS doc_hash
       FROM v_docs""",
)
def t12(spark, sf):
    c = F.col
    return standin(spark, sf, "v_docs").select("id", T.doc_hash(c("content"), c("title"), c("source"), c("quality")).alias("doc_hash"))


@query("t13_original", "SELECT doc_id, length(substring(text, 1, 8000)) AS n, md5(substring(text, 1, 8000)) AS h FROM documents")
def t13(spark, sf):
    o = T.original(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(o).cast("long").alias("n"), F.md5(o).alias("h"))


@query(
    "t14_norm_query",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace('  ' || text || chr(10), '\\A{T.SPACE}+|{T.SPACE}+\\z', '', 'g'), '{T.SPACE}+', ' ', 'g')) AS h,
              'PROJ-' || doc_id AS norm_id FROM documents""",
)
def t14(spark, sf):
    docs = spread_small(table(spark, sf, "documents"), "doc_id")
    return docs.select(
        "doc_id",
        F.md5(T.norm_query(F.concat(F.lit("  "), "text", F.lit("\n")))).alias("h"),
        T.norm_query(F.concat(F.lit(" PROJ-"), "doc_id", F.lit(" "))).alias("norm_id"),
    )


@query(
    "t15_snippet",
    f"""SELECT doc_id, CASE WHEN length(b) > 400 THEN substring(b, 1, 400) || '...' ELSE b END AS snippet FROM (
        SELECT doc_id, regexp_replace(text, '\\A{T.SPACE}+|{T.SPACE}+\\z', '', 'g') AS b FROM documents)""",
)
def t15(spark, sf):
    front = F.concat(F.lit("---\nlang: "), "lang", F.lit("\n---\n\n"), "text")
    body = F.when(F.col("doc_id") % 2 == 0, front).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.snippet(body).alias("snippet"))


@query(
    "t16_prompt",
    """SELECT * FROM (SELECT conv_id, CAST(turn AS BIGINT) AS place, CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' END
                         || text || chr(10) || chr(10) AS block FROM conversations) WHERE block IS NOT NULL
       UNION ALL SELECT conv_id, max(turn) + 1, 'Assistant: ' FROM conversations GROUP BY conv_id""",
)
def t16(spark, sf):
    return C.to_prompt(table(spark, sf, "conversations"))


@query(
    "t17_transcripts",
    f"""SELECT conv_id AS audio_id, turn * 10 AS start_s, regexp_replace(text, '\\A{T.SPACE}+|{T.SPACE}+\\z', '', 'g') AS text,
              max(turn * 10 + 9) OVER (PARTITION BY conv_id) AS duration_s, count(*) OVER (PARTITION BY conv_id) AS n_segments
       FROM conversations""",
)
def t17(spark, sf):
    seg = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("audio_id"), (F.col("turn") * 10).alias("start_s"), (F.col("turn") * 10 + 9).alias("end_s"),
        F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"),
    )
    return C.transcripts(seg)


@query(
    "t16_prompt_text",
    """SELECT conv_id, coalesce(string_agg(block, '' ORDER BY turn), '') || 'Assistant: ' AS prompt FROM (
         SELECT conv_id, turn, CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' END
                || text || chr(10) || chr(10) AS block FROM conversations) GROUP BY conv_id""",
)
def t16_text(spark, sf):
    return C.prompts(table(spark, sf, "conversations"))


@query(
    "t17_transcript_text",
    f"""SELECT conv_id AS audio_id, string_agg(regexp_replace(text, '\\A{T.SPACE}+|{T.SPACE}+\\z', '', 'g'), ' ' ORDER BY turn) AS text,
              max(turn * 10 + 9) AS duration_s, count(*) AS n_segments FROM conversations GROUP BY conv_id""",
)
def t17_text(spark, sf):
    segments = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("audio_id"), (F.col("turn") * 10).alias("start_s"), (F.col("turn") * 10 + 9).alias("end_s"), "text"
    )
    return C.transcript_texts(segments)

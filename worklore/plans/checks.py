"""Check-only SQL shared by several checks."""

from worklore.functions.text import NOT_SPACE, SENTENCE
from worklore.plans.standins import CHECK_VIEWS

# Sentence packing: a chunk runs from sentence a to b; the next one starts at
# the earliest sentence whose tail up to b is worth at most 64 tokens.
CHECK_VIEWS["c_chunks"] = f"""+
c_parts AS (
  SELECT id, CASE WHEN len(parts) > 0 THEN parts ELSE [content] END AS parts FROM (
    SELECT id, content, list_filter(regexp_extract_all(content, '{SENTENCE}'),
                                    lambda x: regexp_matches(x, '{NOT_SPACE}')) AS parts
    FROM v_docs WHERE ceil(length(content) / 4.0) > 600)),
c_cum AS (
  SELECT id, parts, list_transform(range(1, len(tk) + 1), lambda i: list_sum(tk[1:i])) AS cum
  FROM (SELECT id, parts, list_transform(parts, lambda x: CAST(ceil(length(x) / 4.0) AS BIGINT)) AS tk FROM c_parts)),
c_spans AS (
  SELECT id, 0 AS i, CAST(1 AS BIGINT) AS a, greatest(1, len(list_filter(cum, lambda x: x <= 512))) AS b FROM c_cum
  UNION ALL
  SELECT id, i + 1, a2, greatest(b + 1, len(list_filter(cum, lambda x: x - (CASE WHEN a2 = 1 THEN 0 ELSE cum[a2 - 1] END) <= 512)))
  FROM (SELECT s.id, s.i, s.b, c.cum,
               greatest(s.a, 1 + (CASE WHEN c.cum[s.b] > 64 THEN 1 ELSE 0 END)
                        + len(list_filter(c.cum[1:s.b], lambda x: c.cum[s.b] - x > 64))) AS a2
        FROM c_spans s JOIN c_cum c ON s.id = c.id WHERE s.b < len(c.cum))),
c_pieces AS (
  SELECT s.id AS doc, s.i, array_to_string(c.parts[s.a:s.b], '') AS chunk,
         count(*) OVER (PARTITION BY s.id) AS n
  FROM c_spans s JOIN c_cum c ON s.id = c.id
  UNION ALL
  SELECT id, 0, content, 1 FROM v_docs WHERE ceil(length(content) / 4.0) <= 600),
c_chunks AS (
  SELECT doc, CASE WHEN n > 1 THEN doc || '_chunk_' || i ELSE doc END AS id, chunk,
         CASE WHEN n > 1 THEN doc END AS parent_doc_id, CASE WHEN n > 1 THEN i END AS chunk_index,
         CASE WHEN n > 1 THEN n END AS total_chunks, substring(sha256(chunk), 1, 16) AS content_hash
  FROM c_pieces)"""

# One row per index row, as the search reads it.
CHECK_VIEWS["c_index"] = """
  SELECT c.id, c.parent_doc_id, c.chunk_index, c.chunk, c.content_hash, d.* EXCLUDE (id),
         epoch_ms(d.created_at) AS created_ms, epoch_ms(d.updated_at) AS updated_ms
  FROM c_chunks c JOIN v_ranked_docs d ON c.doc = d.id"""

TOKEN_SQL = "[\\p{L}\\p{N}]+"


def bm25_sql(rows: str, text: str) -> str:
    """CTEs ending in ``scored`` (qid, id, score) over ``rows`` (id, title, text)."""
    return f"""
qterms AS (SELECT qid, term, count(*) AS times FROM (
    SELECT qid, unnest(regexp_extract_all(lower(query), '{TOKEN_SQL}')) AS term FROM v_queries) GROUP BY qid, term),
toks AS MATERIALIZED (SELECT id, 0 AS field, regexp_extract_all(lower({text}), '{TOKEN_SQL}') AS t FROM {rows}
         UNION ALL SELECT id, 1, regexp_extract_all(lower(title), '{TOKEN_SQL}') FROM {rows}),
fstats AS (SELECT field, count(*) AS n, avg(len(t)) AS avg_len FROM toks WHERE len(t) > 0 GROUP BY field),
tf AS MATERIALIZED (SELECT id, field, term, len, count(*) AS tf FROM (SELECT id, field, len(t) AS len, unnest(t) AS term FROM toks)
       WHERE term IN (SELECT term FROM qterms) GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
by_field AS (SELECT q.qid, tf.id, tf.field, sum(q.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2
                 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.len / avg_len))) AS s
             FROM tf JOIN dfs USING (field, term) JOIN fstats USING (field) JOIN qterms q ON q.term = tf.term GROUP BY ALL),
scored AS (SELECT qid, id, (floor((greatest(coalesce(sum(s) FILTER (field = 0), 0), 3 * coalesce(sum(s) FILTER (field = 1), 0))) * 1073741824 + 0.5) / 1073741824) AS score
           FROM by_field GROUP BY qid, id)"""


AS_OF_MS = 1706659200000  # 2024-01-31 00:00 UTC

DECAY_SQL = (
    f"(0.3 * coalesce(pow(0.5, greatest(0, {AS_OF_MS} - updated_ms - 604800000) / 2592000000.0), 1.0))"
)
KNN_SQL = """
centres AS (SELECT topic, list(m ORDER BY pos) AS q FROM (
    SELECT topic, pos, avg(x) AS m FROM (
      SELECT topic, generate_subscripts(embedding, 1) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM v_vectors)
    GROUP BY topic, pos) GROUP BY topic),
near_all AS (SELECT c.topic AS qtopic, v.id, (floor(((1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.q)) / 2) * 1073741824 + 0.5) / 1073741824) AS score
             FROM v_vectors v, centres c),
near AS (SELECT * FROM near_all QUALIFY row_number() OVER (PARTITION BY qtopic ORDER BY score DESC, id) <= 200)"""
PERSONAL_SQL = f"""
 (1 + 0.20 * CASE WHEN coalesce(updated_at, other_at) IS NULL THEN 0 ELSE pow(0.5, greatest(0, {AS_OF_MS} - epoch_ms(coalesce(updated_at, other_at))) / 86400000.0
        / CASE source WHEN 'slack' THEN 7 WHEN 'calendar' THEN 14 WHEN 'gmail' THEN 14 WHEN 'jira' THEN 30 ELSE 90 END) END
    + 0.10 * CASE WHEN is_owner OR is_organizer THEN 1.0 WHEN is_assigned_to_me THEN 0.8 ELSE 0 END
    + 0.05 * CASE source WHEN 'slack' THEN least(1.0, reaction_count * 0.1 + mention_count * 0.15 + CASE WHEN thread_ts IS NOT NULL THEN 0.2 ELSE 0 END)
                         WHEN 'jira' THEN least(1.0, priority_weight / 5.0)
                         WHEN 'gmail' THEN CASE WHEN thread_depth > 3 THEN 0.6 WHEN thread_depth > 1 THEN 0.3 ELSE 0 END
                         WHEN 'confluence' THEN least(1.0, label_count * 0.15) ELSE 0 END
    + 0.10 * relevance_score)"""


def pipeline_sql(hits: str, limit: int, offset: int = 0) -> str:
    """CTEs from a hit table (qid, id, score) to the final page ``final_page``."""
    fetch = limit + offset
    return f"""
page AS (SELECT * FROM {hits} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= {fetch}),
joined AS (SELECT p.qid, p.score, i.*, count(*) OVER (PARTITION BY qid, coalesce(parent_doc_id, i.id)) AS n_chunks
           FROM page p JOIN c_index i ON p.id = i.id),
best AS (SELECT * REPLACE ((floor((CASE WHEN n_chunks > 1 THEN score * (1 + least(0.05 * ln(n_chunks), 0.15)) ELSE score END) * 1073741824 + 0.5) / 1073741824) AS score)
         FROM joined QUALIFY row_number() OVER (PARTITION BY qid, coalesce(parent_doc_id, id) ORDER BY joined.score DESC, id) = 1),
personal AS (SELECT qid, id, source, n_chunks, updated_at, other_at, (floor((score * {PERSONAL_SQL}) * 1073741824 + 0.5) / 1073741824) AS score FROM best),
final_page AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position,
               count(*) OVER (PARTITION BY qid) AS total FROM personal)"""

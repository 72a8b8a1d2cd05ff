"""Queries L01 to L09 and K01 to K08: ledger, tasks, corrections."""

from pyspark.sql import functions as F

from worklore.functions.text import epoch_ms
from worklore.operators import ledger as L
from worklore.operators import tasks as K
from worklore.plans.q_sources import c
from worklore.plans.registry import query
from worklore.plans.standins import CHECK_VIEWS, ORDERS_AS_OF, standin, table
from worklore.session import fresh_path

IN_CYCLE = "(paid_at IS NULL OR CAST(paid_at AS DATE) > DATE '2001-07-15')"


def ms(name):
    return epoch_ms(c(name))


def ledger(spark, sf):
    return standin(spark, sf, "v_ledger")


@query("l01_ledger", "SELECT merchant, CAST(amount AS DOUBLE) AS amount, epoch_ms(purchased_at) AS purchased_ms, epoch_ms(paid_at) AS paid_ms, category FROM v_ledger")
def l01(spark, sf):
    path = fresh_path(spark, "ledger")
    raw = standin(spark, sf, "v_ledger_raw")
    text = lambda n: F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = F.struct(F.struct(
        c("merchant").alias("merchantName"), c("actual_amount").alias("actualPaymentAmount"), c("original_amount").alias("originalAmount"),
        text("purchased_at").alias("purchaseDate"), text("paid_at").alias("paymentDate"), F.lit("ILS").alias("originalCurrency"), c("category").alias("categoryId"),
    ).alias("json"))
    raw.select(F.array(row).alias("transactions")).write.json(path)
    out = L.ledger(spark, path, multi_line=False)
    return out.select("merchant", c("amount").cast("double").alias("amount"), ms("purchased_at").alias("purchased_ms"), ms("paid_at").alias("paid_ms"), "category")


@query("l02_cycle", f"SELECT row_id, CAST(amount AS DOUBLE) AS amount FROM v_ledger WHERE {IN_CYCLE}")
def l02(spark, sf):
    return L.cycle(ledger(spark, sf), ORDERS_AS_OF).select("row_id", c("amount").cast("double").alias("amount"))


CHECK_VIEWS["c_dups"] = """
  SELECT *, lag(purchased_at) OVER w AS prev_at, lag(row_id) OVER w AS prev_row FROM v_ledger
  WINDOW w AS (PARTITION BY merchant, amount ORDER BY purchased_at, row_id)"""


@query("l03_duplicates", "SELECT row_id, merchant, prev_row FROM c_dups WHERE epoch_ms(purchased_at) - epoch_ms(prev_at) <= 86400000")
def l03(spark, sf):
    return L.duplicates(ledger(spark, sf)).select("row_id", "merchant", c("prev_row_id").alias("prev_row"))


CHECK_VIEWS["c_subs"] = """
  SELECT merchant, count(DISTINCT date_trunc('month', purchased_at)) AS months, min(purchased_at) AS first_at, max(purchased_at) AS last_at,
         arg_max(amount, (purchased_at, row_id)) AS last_amount FROM v_ledger GROUP BY merchant
  HAVING merchant IN ('Netflix', 'Spotify', 'Apple', 'Google', 'Adobe') OR count(DISTINCT date_trunc('month', purchased_at)) >= 3"""
CHECK_VIEWS["c_changes"] = f"""
  SELECT row_id, l.merchant, amount, CASE WHEN CAST(first_at AS DATE) > DATE '2001-07-15' THEN 'New Subscription' WHEN amount > prev THEN 'Price Increase' END AS finding
  FROM (SELECT *, lag(amount) OVER (PARTITION BY merchant ORDER BY purchased_at, row_id) AS prev FROM v_ledger) l JOIN c_subs s ON l.merchant = s.merchant WHERE {IN_CYCLE}"""


@query("l04_sub_changes", "SELECT row_id, merchant, finding FROM c_changes WHERE finding IS NOT NULL")
def l04(spark, sf):
    return L.sub_changes(ledger(spark, sf), ORDERS_AS_OF).select("row_id", "merchant", "finding")


@query("l05_high_value", "SELECT row_id, CAST(amount AS DOUBLE) AS amount FROM v_ledger WHERE amount > 1000")
def l05(spark, sf):
    return L.high_value(ledger(spark, sf)).select("row_id", c("amount").cast("double").alias("amount"))


@query(
    "l06_subscriptions",
    """SELECT merchant, months, CASE WHEN active THEN 'active' ELSE 'stopped' END AS status, CASE WHEN active THEN CAST(last_amount AS DOUBLE) ELSE 0.0 END AS monthly,
              CASE WHEN active THEN CAST(last_amount * 12 AS DOUBLE) ELSE 0.0 END AS yearly
       FROM (SELECT *, date_diff('day', CAST(last_at AS DATE), DATE '2001-08-02') <= 31 AS active FROM c_subs)""",
)
def l06(spark, sf):
    s = L.subscriptions(ledger(spark, sf), ORDERS_AS_OF)
    return s.select("merchant", "months", "status", c("monthly").cast("double").alias("monthly"), c("yearly").cast("double").alias("yearly"))


@query(
    "l06_totals",
    "SELECT count(*) AS n_active, CAST(sum(last_amount) AS DOUBLE) AS monthly, CAST(sum(last_amount) * 12 AS DOUBLE) AS yearly FROM c_subs WHERE date_diff('day', CAST(last_at AS DATE), DATE '2001-08-02') <= 31",
)
def l06_totals(spark, sf):
    t = L.subscription_totals(L.subscriptions(ledger(spark, sf), ORDERS_AS_OF))
    return t.select("n_active", c("monthly").cast("double").alias("monthly"), c("yearly").cast("double").alias("yearly"))


@query(
    "l07_forecast",
    f"""WITH p AS (SELECT merchant, sum(amount) FILTER ({IN_CYCLE}) AS now, arg_max(amount, (purchased_at, row_id)) FILTER (NOT {IN_CYCLE}) AS before FROM v_ledger GROUP BY merchant),
        o AS (SELECT CAST(coalesce(sum(now), 0) AS DOUBLE) AS spent, CAST(coalesce(sum(before) FILTER (merchant IN ('Netflix', 'Rent', 'Internet') AND now IS NULL), 0) AS DOUBLE) AS fixed_left,
                     CAST(coalesce(sum(now) FILTER (merchant NOT IN ('Netflix', 'Rent', 'Internet')), 0) AS DOUBLE) / 18 AS burn FROM p)
        SELECT scenario, round(spent, 4) AS spent, round(fixed_left, 4) AS fixed_left, round(burn, 4) AS burn, round(spent + fixed_left + burn * rate * 13, 4) AS total
        FROM o, (VALUES ('conservative', 1.0), ('optimistic', 0.8), ('pessimistic', 1.2)) s(scenario, rate)""",
)
def l07(spark, sf):
    f = L.forecast(ledger(spark, sf), ORDERS_AS_OF, "2001-08-15")
    return f.select("scenario", *[F.round(x, 4).alias(x) for x in ("spent", "fixed_left", "burn", "total")])


@query(
    "l08_statement",
    """SELECT category, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n, round(CAST(sum(amount) AS DOUBLE) * 100 / CAST((SELECT sum(amount) FROM v_ledger) AS DOUBLE), 6) AS percent FROM v_ledger GROUP BY category""",
)
def l08(spark, sf):
    return L.statement(ledger(spark, sf)).select("category", c("total").cast("double").alias("total"), "n", "percent")


@query(
    "l08_summary",
    f"SELECT CAST(sum(amount) AS DOUBLE) AS spent, round(20000 - CAST(sum(amount) AS DOUBLE), 4) AS net, round(CAST(sum(amount) AS DOUBLE) / 18, 4) AS burn FROM v_ledger WHERE {IN_CYCLE}",
)
def l08_summary(spark, sf):
    s = L.summary(L.cycle(ledger(spark, sf), ORDERS_AS_OF), ORDERS_AS_OF)
    return s.select("spent", F.round("net", 4).alias("net"), F.round("burn", 4).alias("burn"))


@query(
    "l09_findings",
    f"""SELECT row_id, 'Potential Duplicate' AS finding, 'critical' AS severity FROM c_dups WHERE epoch_ms(purchased_at) - epoch_ms(prev_at) <= 86400000 AND {IN_CYCLE}
        UNION ALL SELECT row_id, finding, 'warning' FROM c_changes WHERE finding IS NOT NULL UNION ALL SELECT row_id, 'High Value', 'warning' FROM v_ledger WHERE amount > 1000 AND {IN_CYCLE}""",
)
def l09(spark, sf):
    return L.findings(ledger(spark, sf), ORDERS_AS_OF).select("row_id", "finding", "severity")


def tasks(spark, sf):
    return standin(spark, sf, "v_tasks")


@query("k01_due", "SELECT task_id, epoch_ms(execute_at) AS at_ms FROM v_tasks WHERE NOT executed AND execute_at <= TIMESTAMP '2000-01-01 12:00:00'")
def k01(spark, sf):
    return K.due(tasks(spark, sf), "2000-01-01 12:00:00").select("task_id", ms("execute_at").alias("at_ms"))


@query("k01_agenda", "SELECT task_id, executed FROM v_tasks WHERE execute_at >= TIMESTAMP '2000-01-01 00:00:00' AND execute_at < TIMESTAMP '2000-01-02 00:00:00'")
def k01_agenda(spark, sf):
    return K.agenda(tasks(spark, sf), "2000-01-01 00:00:00").select("task_id", "executed")


# An hour that comes twice in autumn is read as the first of the two.
@query(
    "k02_zones",
    """SELECT task_id, strftime(CASE WHEN timezone('Asia/Jerusalem', timezone('UTC', u - INTERVAL 1 HOUR)) = execute_at THEN u - INTERVAL 1 HOUR ELSE u END, '%Y-%m-%d %H:%M:%S') AS utc,
              strftime(timezone('Asia/Jerusalem', timezone('UTC', execute_at)), '%Y-%m-%d %H:%M:%S') AS local
       FROM (SELECT *, timezone('UTC', timezone('Asia/Jerusalem', execute_at)) AS u FROM v_tasks)""",
)
def k02(spark, sf):
    text = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return tasks(spark, sf).select("task_id", text(K.to_utc(c("execute_at"))).alias("utc"), text(K.from_utc(c("execute_at"))).alias("local"))


@query(
    "k03_roll",
    """SELECT task_id, strftime(CASE WHEN t > TIMESTAMP '2001-08-02 08:30:00' THEN t ELSE t + INTERVAL 1 DAY END, '%Y-%m-%d %H:%M') AS run_at
       FROM (SELECT task_id, TIMESTAMP '2001-08-02 00:00:00' + (execute_at - date_trunc('day', execute_at)) AS t FROM v_tasks)""",
)
def k03(spark, sf):
    at = K.roll(F.date_format("execute_at", "HH:mm"), "2001-08-02 08:30:00")
    return tasks(spark, sf).select("task_id", F.date_format(at, "yyyy-MM-dd HH:mm").alias("run_at"))


@query(
    "k04_expand",
    """WITH m AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-08-02 08:00:00', TIMESTAMP '2001-08-19 23:59:00', INTERVAL 1 MINUTE)) AS TIMESTAMP) AS t),
       r AS (SELECT '0 7 * * *' AS recurrence, t FROM m WHERE minute(t) = 0 AND hour(t) = 7
             UNION ALL SELECT '30 7 * * 1-5', t FROM m WHERE minute(t) = 30 AND hour(t) = 7 AND dayofweek(t) BETWEEN 1 AND 5
             UNION ALL SELECT '0 8 * * 0,6', t FROM m WHERE minute(t) = 0 AND hour(t) = 8 AND dayofweek(t) IN (0, 6)
             UNION ALL SELECT '0 13 15 * *', t FROM m WHERE minute(t) = 0 AND hour(t) = 13 AND day(t) = 15
             UNION ALL SELECT '*/30 9-10 * * 7', t FROM m WHERE minute(t) IN (0, 30) AND hour(t) IN (9, 10) AND dayofweek(t) = 0)
       SELECT task_id, epoch_ms(t) AS run_ms FROM v_tasks v JOIN r ON v.recurrence = r.recurrence WHERE recurrence_end IS NULL OR t <= recurrence_end""",
)
def k04(spark, sf):
    return K.expand(tasks(spark, sf), "2001-08-02 08:00:00", "2001-08-20 00:00:00").select("task_id", ms("run_at").alias("run_ms"))


@query(
    "k05_records",
    """SELECT task_id, recurrence FROM v_tasks WHERE recurrence LIKE '%7%' AND NOT executed AND task_id > 10 ORDER BY task_id DESC LIMIT 25 OFFSET 5""",
)
def k05(spark, sf):
    where = [("recurrence", "like", "%7%"), ("executed", "eq", False), ("task_id", "gt", 10)]
    return K.records(tasks(spark, sf), where, ["-task_id"], 25, 5).select("task_id", "recurrence")


def corrections(spark, sf):
    v = standin(spark, sf, "v_docs")
    words = F.trim(F.substring(F.regexp_replace("title", "[^a-zA-Z ]", ""), 1, 40))
    return v.select(
        c("lang").alias("domain"), (c("doc_id") + 1).alias("idx"), F.concat(F.lit("Entry "), "doc_id").alias("title"), words.alias("when"),
        F.concat("source", F.lit(" in "), "folder").alias("correction"),
    )


@query(
    "k06_corrections",
    """SELECT lang AS domain, doc_id + 1 AS idx, 'Entry ' || doc_id AS title, trim(substring(regexp_replace(title, '[^a-zA-Z ]', '', 'g'), 1, 40)) AS when_text, source || ' in ' || folder AS correction FROM v_docs""",
)
def k06(spark, sf):
    path = fresh_path(spark, "corrections")
    K.write_corrections(corrections(spark, sf), path)
    return K.read_corrections(spark, path).withColumnRenamed("when", "when_text")


@query(
    "k07_renumber",
    """SELECT lang AS domain, doc_id + 1 AS idx, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS new_idx FROM v_docs WHERE quality IS NULL OR quality = 1""",
)
def k07(spark, sf):
    kept = standin(spark, sf, "v_docs").filter(c("quality").isNull() | (c("quality") == 1)).select(c("lang").alias("domain"), (c("doc_id") + 1).alias("idx"))
    return K.renumber(kept)


@query(
    "k08_similar",
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
       s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END) AS s FROM w),
       k AS (SELECT md5(array_to_string(list_sort(s), '|')) AS k, any_value(s) AS s, count(*) AS copies FROM s GROUP BY 1),
       x AS (SELECT k, len(s) AS n, unnest(s) AS sh FROM k),
       p AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.sh = b.sh AND a.k < b.k GROUP BY ALL),
       hit AS (SELECT unnest([a, b]) AS k FROM p WHERE shared >= 0.8 * (na + nb - shared) UNION SELECT k FROM k WHERE copies > 1)
       SELECT doc_id AS id, md5(array_to_string(list_sort(s), '|')) IN (SELECT k FROM hit) AS similar FROM s""",
)
def k08(spark, sf):
    return K.similar(table(spark, sf, "documents").select(c("doc_id").alias("id"), "text"), 0.8)

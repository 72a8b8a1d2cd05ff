import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from worklore.operators import ledger as L
from worklore.operators import projects as J
from worklore.operators import runs as A
from worklore.operators import search as S
from worklore.operators import spread as P
from worklore.operators import tasks as K
from worklore.operators import upsert as U
from worklore.sources import files
from worklore.streaming import feeds
from worklore.session import fresh_path


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hot_keys_give_the_same_numbers(spark):
    rnd = random.Random(1)
    for share in (3, 100):
        keys = [None if i % share == 1 else "hot" if i % share else f"k{i % 7}" for i in range(600)]
        data = [(k, rnd.randint(0, 40), i, rnd.randint(1, 9)) for i, k in enumerate(keys)]
        df = spark.createDataFrame(data, "k string, b int, seq int, v int")
        both = P.running(df, ["k"], [F.col("b"), F.col("seq")], s=("sum", F.col("v")), x=("xor", F.col("v").cast("long")))
        got = both.select("k", "seq", "s", "x")
        prev = P.previous(df, ["k"], ["b", "seq"], ["seq"]).select("k", "seq", "prev_seq")
        want_sum, want_prev, state, last, bits = [], [], {}, {}, {}
        for k, b, seq, v in sorted(data, key=lambda r: (r[1], r[2])):
            state[k], bits[k] = state.get(k, 0) + v, bits.get(k, 0) ^ v
            want_sum.append((k, seq, state[k], bits[k]))
            want_prev.append((k, seq, last.get(k)))
            last[k] = seq
        assert sorted_rows(got) == sorted(want_sum, key=str)
        assert sorted_rows(prev) == sorted(want_prev, key=str)
    assert P.numbered(df.limit(0), [], [F.col("seq")]).count() == 0


def test_a_hot_key_is_dealt_out_evenly(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("seq"))
    rows, crossing = P._dealt(df, ["k"], [F.col("seq")])
    sizes = sorted(r["count"] for r in rows.groupBy("_r").count().collect())
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2] and crossing.count() == 1
    back, _ = P._windowed(rows, [F.col("seq")])
    assert sorted(r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()) == sizes
    got = P.numbered(df, ["k"], [F.col("seq")], "n").filter("k = 1").agg(F.count("*"), F.countDistinct("n"), F.max("n")).first()
    assert tuple(got) == (36_000, 36_000, 36_000)


def test_mean_duration_bound(spark):
    rnd = random.Random(5)
    data = [("s", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), rnd.choice([0, 1, 5, 9, 30])) for i in range(400)]
    mean = 0
    for n, (_, _, _, d) in enumerate(data, 1):
        if d:
            mean = math.floor((mean * (n - 1) + d) / n + 0.5)
    df = spark.createDataFrame(data, "source string, seq long, started_at timestamp, duration_ms long")
    assert A.mean_duration(df).collect()[0].mean_ms == mean


def test_bm25_brute_force(spark):
    docs = [("a", "red fox jumps", "fox"), ("b", "red red dog", "dog story"), ("c", "", "nothing"), ("d", "blue whale", "red")]
    index = spark.createDataFrame(docs, "id string, content string, title string")
    got = {(r.qid, r.id): r.score for r in S.bm25(index, spark.createDataFrame([(1, "Red  fox red")], "qid long, query string")).collect()}

    def field(i):
        bags = {d[0]: d[i].lower().split() for d in docs}
        full = [b for b in bags.values() if b]
        avg = sum(map(len, full)) / len(full)
        out = {}
        for k, bag in bags.items():
            total = 0
            for term, times in (("red", 2), ("fox", 1)):
                n = sum(term in b for b in full)
                tf = bag.count(term)
                if tf:
                    total += times * math.log(1 + (len(full) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / avg))
            out[k] = total
        return out

    text, title = field(1), field(2)
    want = {(1, k): max(text[k], 3 * title[k]) for k in text if max(text[k], title[k]) > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_knn_blocks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(0)
    vec = rng.normal(size=(90, 8))
    vec[40:50] = vec[40]
    df = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(vec)], "id string, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in vec[i * 7]]) for i in range(9)], "qid long, embedding array<double>")
    monkeypatch.setattr(S, "QUERY_BLOCK", 4)
    got = sorted_rows(S.knn(df, queries, 5).select("qid", "rank", "id"))
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    want = []
    for q in range(9):
        sim = np.floor((1 + unit @ unit[q * 7]) / 2 * 2**30 + 0.5)
        order = sorted(range(90), key=lambda i: (-sim[i], f"v{i:03d}"))[:5]
        want += [(q, r + 1, f"v{i:03d}") for r, i in enumerate(order)]
    assert got == sorted(want, key=str)


def test_search_keeps_unmatched_sources_when_list_is_empty(spark):
    df = spark.createDataFrame([("a", "jira", 5), ("b", "slack", None)], "id string, source string, created_ms long")
    assert S.filters(df, []).count() == 2
    assert S.filters(df, ["jira"]).count() == 1
    assert S.filters(df, start="1970-01-01").count() == 1 and S.filters(df, start="no date").count() == 2


def test_similar_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=60)) for _ in range(12)]
    texts = list(base)
    for b in base[:6]:
        for _ in range(4):
            w = b.split()
            w[rnd.randrange(60)] = "new"
            texts.append(" ".join(w))
    texts += [base[7], "two words", "", "", "Two  WORDS!"]

    def shingles(t):
        w = "".join(ch if ch.isalnum() else " " for ch in t.lower()).split()
        return frozenset(" ".join(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([" ".join(w)])

    sets = [shingles(t) for t in texts]
    for limit in (0.8, 0.9):
        want = [(i, any(i != j and len(a & b) >= limit * len(a | b) for j, b in enumerate(sets))) for i, a in enumerate(sets)]
        got = K.similar(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), limit)
        assert sorted_rows(got) == sorted(want, key=str)


def shuffled(spark, run):
    """Bytes that all tasks write for shuffles while ``run`` is at work."""
    sc = spark.sparkContext._jsc.sc()

    def so_far():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = so_far()
    run()
    return so_far() - before


def test_similar_moves_few_shingles_of_unrelated_texts(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rnd.choices(words, k=1000)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "id long, text string")
    got = []
    # a shingle is 8 bytes; each is moved with its set once in half of all cases
    assert shuffled(spark, lambda: got.extend(K.similar(df).collect())) < 201 * 1000 * 8 * 3
    assert sorted(r.id for r in got if r.similar) == [0, 200]


def test_link_docs_meets_in_cells(spark):
    links = [(f"P{i}", "jira_project", "A") for i in range(7)] + [("P0", "jira_project", "B"), ("P0", "jira_project", "A"), ("P1", "slack_channel", "A"), ("P1", "jira_project", None)]
    docs = [(f"d{i}", "jira", "A", "-") for i in range(5)] + [("d0", "jira", "B", "-"), ("d1", "jira", "A", "-"), ("d9", "jira", None, "-"), ("d0", "slack", "-", "A"), ("m", "mail", "A", "A")]
    column = {"jira": 2, "slack": 3}
    want = {(p, d[0], d[1]) for p, kind, name in links for d in docs if d[1] == kind.split("_")[0] and name is not None and d[column[d[1]]] == name}
    a, b = spark.createDataFrame(links, "project_id string, kind string, identifier string"), spark.createDataFrame(docs, "id string, source string, project string, channel string")
    for cell in (2, 1000):
        got = [tuple(r) for r in J.link_docs(a, b, cell).collect()]
        assert len(got) == len(want) and set(got) == want


def test_link_docs_does_not_shuffle_pairs(spark):
    links = spark.range(1500).selectExpr("concat('P', id) project_id", "'jira_project' kind", "'A' identifier")
    docs = spark.range(1500).selectExpr("concat('d', id) id", "'jira' source", "'A' project")
    n = []
    assert shuffled(spark, lambda: n.append(J.link_docs(links, docs).count())) < 1_000_000
    assert n == [1500 * 1500]


def test_best_chunk_shuffles_hits_once(spark):
    hits = [(1, "a1", "a", 2.0), (1, "a2", "a", 3.0), (1, "a0", "a", 3.0), (1, "b", None, 1.0), (2, "a1", "a", 5.0), (2, "a", None, 5.0)]
    best = S.best_chunk(spark.createDataFrame(hits, "qid long, id string, parent_doc_id string, score double"))
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted_rows(best.select("qid", "id", "score", "n_chunks")) == [(1, "a0", 3.0, 3), (1, "b", 1.0, 1), (2, "a", 5.0, 2)]


def test_schedule_fields(spark):
    df = spark.createDataFrame(
        [(1, "*/20 6-7 * * *", None), (2, "0 0 1 * 1", None), (3, "5 4 * 2 7", None)], "task_id long, recurrence string, recurrence_end timestamp"
    )
    runs = K.expand(df, "2024-02-01 00:00:00", "2024-02-08 00:00:00").collect()
    by = lambda t: sorted(str(r.run_at) for r in runs if r.task_id == t)
    assert len(by(1)) == 6 * 7
    assert by(2) == ["2024-02-01 00:00:00", "2024-02-05 00:00:00"]
    assert by(3) == ["2024-02-04 04:05:00"]


def test_duplicates_across_midnight(spark):
    at = dt.datetime(2024, 1, 1, 23, 30)
    data = [("a", at, "m", 5), ("b", at + dt.timedelta(hours=1), "m", 5), ("c", at + dt.timedelta(hours=26), "m", 5), ("d", at, "n", 5)]
    df = spark.createDataFrame(data, "row_id string, purchased_at timestamp, merchant string, amount int")
    assert sorted_rows(L.duplicates(df).select("row_id", "prev_row_id")) == [("b", "a")]


def test_folder_cycles(spark):
    rows = [("a", "A", None)] + [(f"n{i}", f"N{i}", f"n{i - 1}" if i else "a") for i in range(12)] + [("x", "X", "y"), ("y", "Y", "x"), ("z", "Z", "x"), ("s", "S", "s"), ("o", "O", "gone")]
    chains = files.folder_chains(spark.createDataFrame(rows, "folder_id string, name string, parent_id string"))
    path = {r.folder_id: r.path for r in files.folder_paths(chains).collect()}
    assert path["n11"] == "A/" + "/".join(f"N{i}" for i in range(12))
    assert (path["x"], path["y"], path["z"], path["s"], path["o"]) == ("Y/X", "X/Y", "Y/X/Z", "S", "O")


def test_upsert_keeps_text_of_metadata_rows(spark):
    index = spark.createDataFrame([("a", None, "old", "t1"), ("d_chunk_0", "d", "x", "t"), ("d_chunk_1", "d", "y", "t")], "id string, parent_doc_id string, chunk string, title string")
    new = spark.createDataFrame([("a", None, "ignored", "t2", "meta"), ("d_chunk_0", "d", "x2", "t", "full")], "id string, parent_doc_id string, chunk string, title string, route string")
    keep = {r.id: (r.chunk, r.title) for r in U.upsert(index, new, ["chunk"]).collect()}
    assert keep == {"a": ("old", "t2"), "d_chunk_0": ("x2", "t"), "d_chunk_1": ("y", "t")}
    assert sorted(r.id for r in U.upsert(index, new, ["chunk"], prune=True).collect()) == ["a", "d_chunk_0"]


def test_late_runs_count(spark):
    path = fresh_path(spark, "late")
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "source string, completed_at timestamp, docs long, status string"
    for page in ([("a", day(1), 1, "ok"), ("a", day(5), 2, "error")], [("a", day(1, 3), 9, "ok"), ("a", day(9), 1, "ok")]):
        df = spark.createDataFrame(page, schema)
        feeds.land(df, path)
        feeds.daily_stream(feeds.landed(spark, df, path), path).awaitTermination()
    out = feeds.daily_now(spark, path).orderBy("day").select("runs", "docs", "errors").collect()
    assert [tuple(r) for r in out] == [(2, 10, 0), (1, 2, 1), (1, 1, 0)]


def test_missing_times_and_owners(spark):
    from pyspark.sql import functions as F

    from worklore.functions import ranking, relevance
    from worklore.operators import runs as A

    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([(None,), (dt.datetime(2024, 1, 1),), (dt.datetime(2024, 3, 1),)], "at timestamp")
    assert [r[0] for r in rows.select(relevance.days_since(F.col("at"), now)).collect()] == [999, 30, 0]
    assert [round(r[0], 3) for r in rows.select(ranking.recency(F.lit("jira"), F.col("at"), 1706659200000)).collect()] == [0.0, 0.5, 1.0]
    zero = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1), 0), ("b", 2, dt.datetime(2024, 1, 1), 5)], "source string, seq long, started_at timestamp, duration_ms long")
    assert {tuple(r) for r in A.mean_duration(zero).collect()} == {("a", 0), ("b", 5)}


def test_text_that_goes_back_is_a_change(spark):
    path = fresh_path(spark, "back")
    for n, text in enumerate("ABBA"):
        df = spark.createDataFrame([("x", text, dt.datetime(2024, 1, 1 + 40 * n // 39))], "id string, doc_hash string, seen_at timestamp")
        feeds.land(df, path)
        feeds.dedupe_stream(feeds.landed(spark, df, path), path).awaitTermination()
    assert sorted(r.doc_hash for r in spark.read.parquet(f"{path}/docs").collect()) == ["A", "A", "B"]


def test_vector_search_in_blocks(spark, monkeypatch):
    import numpy as np

    from worklore.operators import search as S

    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(rng.standard_normal((60, 8)))], "id string, embedding array<double>")
    queries = vectors.selectExpr("id as qid", "embedding")
    whole = {(r.qid, r.id, r["rank"]) for r in S.knn(vectors, queries, 5).collect()}
    monkeypatch.setattr(S, "QUERY_BLOCK", 16)
    assert {(r.qid, r.id, r["rank"]) for r in S.knn(vectors, queries, 5).collect()} == whole and len(whole) == 300


def test_large_pages_are_cut_in_parts(spark):
    from worklore.operators import search as S

    hits = spark.range(5000).selectExpr("id % 2 as qid", "cast(id as string) as id", "cast(id % 700 as double) as score")
    got = S.top_per_query(hits, 1500).collect()
    want = {q: [r.id for r in sorted(hits.filter(f"qid = {q}").collect(), key=lambda r: (-r.score, r.id))][:1500] for q in (0, 1)}
    assert {q: [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] for q in (0, 1)} == want

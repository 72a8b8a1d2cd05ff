import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from worklore.operators import inverted as I
from worklore.operators import search as S
from worklore.plans import q_search as Q
from worklore.session import fresh_path, materialize


def rows_of(spark, docs):
    return spark.createDataFrame([(i, t, h, at) for i, (t, h, at) in docs.items()], "id string, content string, title string, updated_ms long")


def made_up(seed, n=1500):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = {f"d{i:04d}": (" ".join(rnd.choices(words, weights, k=rnd.randint(0, 30))), " ".join(rnd.choices(words, k=rnd.randint(0, 3))), rnd.choice([None, 10**12, 15 * 10**11])) for i in range(n)}
    for i in range(40):
        docs[f"d{i:04d}"] = ("w7 w7 w8", "w9", 10**12)  # ties at the cut
    return docs


def key(rows):
    return sorted((r.qid, r.id, r.score) for r in rows)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "W7 w8"), (2, "w59 w1 w1"), (3, ""), (4, "nothing"), (5, "w50")], "qid long, query string")


def best(scored, k):
    out = []
    for q in {r[0] for r in scored}:
        out += sorted((r for r in scored if r[0] == q), key=lambda r: (-r[2], r[1]))[:k]
    return sorted(out)


def test_best_k_equals_the_head_of_all(spark, queries, monkeypatch):
    docs = rows_of(spark, made_up(1)).coalesce(1)
    index = I.InvertedIndex.create(spark)
    index.append(docs)
    for as_of in (None, 16 * 10**11):
        whole = key(index.search(queries, as_of_ms=as_of).collect())
        assert key(index.search(queries, 25, as_of).collect()) == best(whole, 25)
    assert key(S.bm25(docs, queries, as_of_ms=as_of).collect()) == whole
    monkeypatch.setattr(I, "QUERY_BLOCK", 2)
    assert key(index.search(queries, 25).collect()) == best(key(index.search(queries).collect()), 25)
    assert index.search(queries.limit(0), 5).count() == 0


def test_blocks_below_the_bound_are_not_scored(spark, queries, monkeypatch):
    docs = {f"d{i:05d}": ("filler " * 20 + "w7", "", None) for i in range(4000)}
    docs |= {f"e{i:02d}": ("w7 w7 w7 w8", "w7", None) for i in range(30)}
    index = I.InvertedIndex.create(spark)
    index.append(rows_of(spark, docs).coalesce(1))
    asked = []
    score = I.InvertedIndex._score
    monkeypatch.setattr(I.InvertedIndex, "_score", lambda self, p, d, pairs, *rest: asked.append(pairs.count()) or score(self, p, d, pairs, *rest))
    found = index.search(queries.where("qid = 1"), 20).collect()
    assert {r.id[0] for r in found} == {"e"} and len(found) == 20
    assert asked == [1, 0]


def test_batches_replace_and_survive(spark, queries):
    old, new = made_up(2, 700), made_up(3, 900)
    index = I.InvertedIndex.create(spark)
    assert index.search(queries).count() == 0 and index.search(queries, 3).count() == 0
    index.append(rows_of(spark, old))
    index.append(rows_of(spark, {i: d for i, d in new.items() if i < "d0300"}))
    index.append(rows_of(spark, {i: d for i, d in new.items() if i >= "d0200"}))
    fresh = I.InvertedIndex.create(spark)
    fresh.append(rows_of(spark, new))
    want = key(fresh.search(queries).collect())
    assert key(index.search(queries).collect()) == want
    # a load that is killed before its manifest row is written changes nothing
    with pytest.raises(Exception, match="stop"):
        index.append(rows_of(spark, old).withColumn("content", F.raise_error(F.lit("stop")).cast("string")))
    assert key(index.search(queries).collect()) == want
    index.compact()
    assert len(index.batches()) == 1 and key(index.search(queries, 25).collect()) == best(want, 25)


def test_only_asked_buckets_are_opened(spark, queries):
    index = I.InvertedIndex.create(spark)
    index.append(rows_of(spark, made_up(4, 200)))
    plan = index.table("postings").where(F.col("bucket").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_postings_are_made_block_by_block(monkeypatch):
    rnd = random.Random(5)
    counts = [[{"term": t, "tf": rnd.randint(1, 3)} for t in sorted(rnd.sample("abcdefgh", rnd.randint(0, 8)))] for _ in range(3000)]
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    lengths = pa.array([sum(x["tf"] for x in c) for c in counts], pa.int32())
    columns = {"doc": pa.array(range(100, 3100), pa.int64()), "at": pa.nulls(3000, pa.int64()), "c0": pa.array(counts, kind), "n0": lengths, "c1": pa.array([[]] * 3000, kind), "n1": pa.array([0] * 3000, pa.int32())}
    whole = pa.RecordBatch.from_pydict(columns)
    want = sorted((x["term"], d, x["tf"]) for d, c in enumerate(counts, 100) for x in c)
    for most in (I.STEP_TERMS, 50, 1):
        monkeypatch.setattr(I, "STEP_TERMS", most)
        made = [part.to_pylist() for part in I._in_blocks([whole, whole.slice(0, 0)])]
        assert all(len({r["block"] for r in part}) == 1 for part in made)
        assert all(sum(r["n"] for r in part) <= max(most, 8) for part in made)
        assert sorted((r["term"], e["doc"], e["tf"]) for part in made for r in part for e in r["entries"]) == want


def test_replaced_documents_are_not_shuffled(spark, queries):
    """Of replaced documents only numbers are kept; the living ones are picked where they lie."""
    index = I.InvertedIndex.create(spark)
    index.append(rows_of(spark, made_up(6, 300)))
    index.append(rows_of(spark, made_up(7, 200)))
    assert index.table("dead").columns == ["doc", "n0", "n1"] and index.table("dead").count() == 200
    assert "entries" not in index.table("postings").columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.living("id", "at", "c0", "c1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_too_many_blocks_for_a_broadcast(spark, queries, monkeypatch):
    index = I.InvertedIndex.create(spark)
    index.append(rows_of(spark, made_up(6, 300)))
    index.append(rows_of(spark, made_up(7, 200)))
    few = sorted(r.id for r in index.living("id").collect())
    monkeypatch.setattr(I, "BROADCAST_BLOCKS", 0)
    assert sorted(r.id for r in index.living("id").collect()) == few and len(few) == 300


def test_names_in_place_of_ids(spark, queries):
    index = I.InvertedIndex.create(spark)
    index.append(rows_of(spark, made_up(8, 200)))
    names = spark.createDataFrame([(f"d{i:04d}", f"n{i % 3}") for i in range(0, 200, 2)], "id string, name string")
    for k in (None, 10):
        want = sorted((r.qid, r.name, r.score) for r in index.search(queries, k).join(names, "id").collect())
        assert want and sorted((r.qid, r.name, r.score) for r in index.search(queries, k, names=names).collect()) == want
    assert index.search(queries.limit(0), names=names).columns == ["qid", "score", "name"]


def in_parts(seed, n=700, most=4):
    """Chunk rows of made-up documents, the chunks of each side by side."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(n):
        chunks = 600 if d == 300 else rnd.randint(1, most)
        for c in range(chunks):
            text = "w7 w8" if rnd.random() < 0.3 else " ".join(rnd.choices(words, k=rnd.randint(0, 12)))  # ties inside a document
            rows.append((f"d{d}_chunk_{c}" if chunks > 1 else f"d{d}", f"d{d}" if chunks > 1 else None, text, "w9" if d % 5 else "", None))
    return rows


def chunk_table(spark, rows):
    return spark.createDataFrame(rows, "id string, parent_doc_id string, content string, title string, updated_ms long").coalesce(1)


def best_rows(hits):
    return sorted((r.qid, r.id, r.parent_doc_id or "", r.score, r.n_chunks) for r in S.best_chunk(hits).collect())


def test_best_parts_are_cut_where_they_are_scored(spark, queries, monkeypatch):
    first, changed = in_parts(9), in_parts(10, 200)
    index = I.InvertedIndex.create(spark)
    assert index.search(queries, parts=True).collect() == []
    for rows in (first, changed):
        path = fresh_path(spark, "chunks")
        chunk_table(spark, rows).write.parquet(path)
        # rows that lie side by side stay so
        monkeypatch.setattr(I, "_in_files", lambda _: True)
        index.append(spark.read.parquet(path))
        monkeypatch.undo()
        names = chunk_table(spark, list({r[0]: r for r in first + (changed if rows is changed else [])}.values())).select("id", "parent_doc_id")
        want = best_rows(index.search(queries).join(names, "id"))
        parts = index.search(queries, parts=True).cache()
        assert want and best_rows(parts) == want
        if rows is first:
            apart = {r.parent_doc_id for r in parts.where("not whole").collect()}
            assert "d300" in apart and len(apart) <= 6
            once = parts.where("whole").groupBy("qid", F.coalesce("parent_doc_id", "id")).count()
            assert once.where("count > 1").isEmpty() and parts.where("whole").count() > 10 * parts.where("not whole").count()
    monkeypatch.setattr(I, "QUERY_BLOCK", 2)
    assert best_rows(index.search(queries, parts=True)) == want
    monkeypatch.setattr(I, "BROADCAST_BLOCKS", 0)
    assert best_rows(index.search(queries, parts=True)) == want


def test_best_chunks_of_scattered_parts(spark, queries):
    rows = in_parts(11, 400)
    random.Random(1).shuffle(rows)
    index = I.InvertedIndex.create(spark)
    index.append(chunk_table(spark, rows))
    index.compact()
    want = best_rows(index.search(queries).join(chunk_table(spark, rows).select("id", "parent_doc_id"), "id"))
    assert want and best_rows(index.search(queries, parts=True)) == want


def test_texts_that_are_spread_are_not_shuffled(spark, queries, monkeypatch):
    rows = in_parts(12, 100)
    path = fresh_path(spark, "chunks")
    chunk_table(spark, rows).repartition(8).write.parquet(path)
    table = spark.read.parquet(path)
    want = S.bm25(table, queries).count()
    index = I.InvertedIndex.create(spark)

    def no_shuffle(*_):
        raise AssertionError("shuffled")

    monkeypatch.setattr(type(table), "repartition", no_shuffle)
    index.append(table)
    assert index.search(queries).count() == want
    assert all(I.zlib.crc32(r.term.encode()) % I.BUCKETS == r.bucket for r in index.table("postings").select("bucket", "term").collect())


def test_chunk_hits_are_not_joined_and_texts_are_stored_once(spark, sf_dir, monkeypatch):
    """The hits of q06 and q07 bring their documents and counts; the index table holds a chunk's text once."""
    kept = []
    monkeypatch.setattr(Q, "materialize", lambda df, name: kept.append(df.columns) or materialize(df, name))
    rows = Q.index(spark, sf_dir)
    assert {"content", "original", "indexed", "content_hash"} <= set(rows.columns) and not {"original", "indexed"} & set(kept[0])
    hits = Q.chunk_hits(spark, sf_dir)
    assert {"n_chunks", "whole"} <= set(hits.columns) and not hits.where("whole and n_chunks > 1").isEmpty()
    plan = hits.where("whole")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CoGroup") == 1 and "Join" not in plan.split("CoGroup")[0]

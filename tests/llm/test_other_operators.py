"""Vectors, archives, components, and the pipeline."""

import base64
import contextlib
import hashlib
import io

import cases
import numpy as np
from pyspark.sql.readwriter import DataFrameWriter

import corpus_pipeline
from worklore.llm import catalog, mih, warc
from worklore.llm.components import components, extended


def test_nearest(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((1500, 24)).astype(np.float32)
    vectors[700:900] = vectors[60]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 24), (2060, [float("nan")] * 24), (2080, [1.0, None] * 12), (2100, [1.0, 2.0]), (2101, [2.0, 1.0]), (None, [1.0] * 24), (60, vectors[60].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as shard", "2 as v")
    got = mih.nearest(table).toPandas()
    wide = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and len(v) == 24 and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, matrix = np.array([i for i, _ in wide]), np.stack([v for _, v in wide])
    hit = total = 0
    for q, query in [(i, v) for i, v in wide if i % 20 == 0 and i != 60]:
        score = mih.exact_scores(query, matrix)
        own = ids == q
        order = [k for k in np.lexsort((ids, -score)) if not own[k]][:20]
        found = got[got.query_id == q].sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 21)) and q not in set(found.vec_id)
        assert np.array_equal(found.score.to_numpy(), np.sort(found.score.to_numpy())[::-1])
        hit, total = hit + len({int(ids[k]) for k in order} & set(found.vec_id)), total + 20
    assert hit / total >= 0.9
    short = got[got.query_id == 2100]
    assert short.vec_id.tolist() == [2101] and short.score.tolist() == [4.0]
    assert mih.nearest(table.limit(0)).count() == 0


def test_codes_retrieve_everything_within_a_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (400, 4), dtype=np.uint8)
    shard = mih.Shard.build(codes)
    for code in codes[:40]:
        distance = np.unpackbits(codes ^ code, axis=1).sum(1)
        found = shard.nearest(code, 25)
        limit = np.sort(distance)[24]
        assert set(found) == set(np.flatnonzero(distance <= limit))


def recall_of_lengths(spread, rows=8192, asked=100):
    """Share of the 20 largest inner products found in one shard of vectors with log-normal lengths."""
    rng = np.random.default_rng(4)
    vectors = mih.directions(rng.standard_normal((rows, 64))) * np.exp(spread * rng.standard_normal((rows, 1)))
    ids, queries = np.arange(rows), vectors[:asked]
    found = mih.search_shard(ids[:asked], queries, ids, vectors, mih.learn_codes(mih.directions(vectors)), 20, mih.RERANK)
    scores = queries @ vectors.T
    scores[np.arange(asked), np.arange(asked)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    return np.mean([len(set(b) & set(f[1])) / 20 for b, f in zip(best.tolist(), found)])


def test_nearest_of_unequal_lengths():
    for spread in (0.0, 0.25, 0.5, 1.0):
        assert recall_of_lengths(spread) >= 0.9, spread


def test_warc(spark):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "é😀\r\n\r\nWARC/1.1\r\n", "x" * 1_200_000, "<p>one</p>", "x" * 1_200_000]
    rows = [(9 - i, f"http://h/{i}\r\nx" if i % 2 else None, h) for i, h in enumerate(html)] + [(50, "u", "<p>lone</p>"), (None, "u", "<p>two</p>"), (50, "u", "<p>lone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n")
    got = warc.archive(pages).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 1 << 60), i)
    assert len(got) == len(rows) and all(r.intact for r in got)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        keeps = i == first[h or ""]
        want.append((-1 if i is None else i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if keeps else "revisit", -1 if keeps else first[h or ""]))
    assert sorted(want) == sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got)
    assert {r.record_type for r in warc.archive(pages, 1 << 30).collect()} == {"response"}
    assert warc.archive(pages.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 102), (101, 102), (7, 7), (0, 60), (100, 102)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, parts.values())) == [list(range(61)), [100, 101, 102]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_queries_against_sql(spark, con, sf_dir):
    import compare

    for name in catalog.CHECKS:
        ok, message = compare.compare(spark, con, sf_dir, name)
        assert ok, (name, message)


def test_pipeline_stages(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n, name
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == n


def test_pipeline_on_awkward_rows(spark, sf_dir):
    docs, rows = cases.awkward(spark, 8)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert 0 < docs.count() < len(rows)


def test_more_edges_extend_components(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    parts = lambda table: {frozenset(g.node) for _, g in table.toPandas().groupby("label")}
    known = [(1, 2), (2, 3), (4, 5), (6, 7), (8, 9), (20, 21)]
    for more in ([], [(1, 3)], [(3, 4), (5, 6), (10, 11), (11, 9), (30, 31), (31, 31), (2, 5)]):
        assert parts(extended(components(edges(known)), edges(more))) == parts(components(edges(known + more))), more


def test_stages_write_by_small_plans(spark, sf_dir, monkeypatch):
    """The driver plans and replans each write as a whole; large plans took it over its memory."""
    found, write = {}, DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            self._df.explain()
        found[path.rsplit("/", 1)[-1]] = plan.getvalue().count("Exchange")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    assert any(x.startswith("places-") for x in found) and any(x.startswith("near-duplicates-") for x in found)
    assert max(found.values()) <= 8, found

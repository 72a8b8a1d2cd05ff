"""The incremental load: merged runs, loads that stop, loads that are repeated."""

import pytest
from pyspark.errors import StreamingQueryException

from worklore.plans.standins import standin
from worklore.streaming import incremental as N
from worklore.streaming.runs import Runs

COLS = "id string, source string, title string, content string, author string, created_at timestamp, updated_at timestamp, seq int"


def page(spark, load, ids):
    rows = [(f"d{i}", "jira", f"t{load}", f"text {i} {load // 2}", "a", None, None, load) for i in ids]
    return spark.createDataFrame(rows, COLS)


def state(job):
    return {r.id: (r.title, r.chunk) for r in job.index().select("id", "title", "chunk").collect()}


def test_loads_are_merged(spark, tmp_path):
    job = N.new_job(spark, ["content", "title"], str(tmp_path / "load"))
    expected, sizes = {}, [40, 3, 3, 3]
    for load, n in enumerate(sizes):
        ids = range(load, load + n)
        job.land(page(spark, load, ids))
        job.run()
        expected |= {f"d{i}": (f"t{load}", i, load // 2) for i in ids}
        found = state(job)
        assert set(found) == set(expected)
        for key, (title, i, version) in expected.items():
            assert found[key][0] == title and f"text {i} {version}" in found[key][1]
        runs = job.stored.of("hashes", 1 << 30)
        assert [r.first for r in runs] == [0, *[r.last + 1 for r in runs[:-1]]]  # no batch is missing or there twice
        assert all(a.rows > 2 * b.rows for a, b in zip(runs, runs[1:]))
    assert runs[0].last == 0  # the large first run is not written again for small ones


def test_stopped_load_leaves_the_old_state(spark, tmp_path, monkeypatch):
    job = N.new_job(spark, ["content", "title"], str(tmp_path / "load"))
    job.land(page(spark, 0, range(5)))
    job.run()
    before = state(job)
    job.land(page(spark, 4, range(3, 8)))

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(Runs, "_swap", stop)
        with pytest.raises(StreamingQueryException):
            job.run()
    assert state(job) == before
    job.run()
    after = state(job)
    assert set(after) == {f"d{i}" for i in range(8)} and after["d3"][0] == "t4" and after["d0"] == before["d0"]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    job = N.new_job(spark, ["content", "title"], str(tmp_path / "load"))
    for load in (0, 1, 1):
        job._load(page(spark, load, range(4)), load)
    assert {t for t, _ in state(job).values()} == {"t1"}
    assert [(r.first, r.last) for r in job.stored.of("index", 1 << 30)] == [(0, 1)]


def test_empty_page(spark, tmp_path):
    job = N.new_job(spark, ["content", "title"], str(tmp_path / "load"))
    job._load(page(spark, 0, range(2)).filter("false"), 0)
    job._load(page(spark, 1, range(2)), 1)
    assert len(state(job)) == 2


def test_texts_are_not_shuffled_without_need(spark, tmp_path, monkeypatch):
    """A first load cuts chunks where the rows lie; a chunk is stored once, and a repeated id in a page still counts once."""
    job = N.new_job(spark, ["content", "title"], str(tmp_path / "load"))
    seen = []
    written = Runs._written
    monkeypatch.setattr(Runs, "_written", lambda self, rows, name, *a: seen.append((name, rows)) or written(self, rows, name, *a))
    job._load(page(spark, 0, range(6)), 0)
    plan = next(rows for name, rows in seen if name == "index")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert "indexed" not in spark.read.parquet(f"{tmp_path}/load/index/run-0-0").columns
    job._load(page(spark, 1, range(6)).union(page(spark, 4, range(2))), 1)
    rows = {r.id: r for r in job.index(prune=True).collect()}
    assert len(rows) == 6 and rows["d0"].title == "t4" and rows["d5"].title == "t1"
    assert rows["d0"].indexed == f"Document: t4\nSource: jira\n\n{rows['d0'].chunk}"
    # the text of d5 is the old one, and so is the header that went with it
    assert rows["d5"].indexed == f"Document: t0\nSource: jira\n\n{rows['d5'].chunk}"


def test_labels_go_to_the_documents(spark, sf_dir):
    """The texts are not shuffled to their labels, whatever Spark's own limit is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = standin(spark, sf_dir, "v_docs")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

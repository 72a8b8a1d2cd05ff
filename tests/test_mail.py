"""Mail part trees of any depth."""

import json

from worklore.sources import mail


def nested(depth, leaf):
    return [{"mimeType": "multipart/mixed", "body": {}, "parts": nested(depth - 1, leaf)}] if depth else [leaf]


def test_parts_are_opened_without_looking_ahead(spark):
    leaf = {"mimeType": "text/plain", "body": {"data": "e3t7"}}
    rows = [(d, json.dumps(nested(d, leaf))) for d in (0, 1, 3, 9)] + [(-1, None), (-2, "[]"), (-3, "no json {{")]
    df = spark.createDataFrame(rows, "d int, parts string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("parts", "with_parts")
    try:
        out = mail.with_parts(df, "parts")
        assert not tracker.getJobIdsForGroup("parts")  # building the table runs nothing
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = {r.d: r.parts_list for r in out.collect()}
    for d in (0, 1, 3, 9):
        assert [p.mimeType for p in found[d]] == ["multipart/mixed"] * d + ["text/plain"] and found[d][-1].body.data == "e3t7"
        assert all(p.parts is None for p in found[d])
    assert found[-1] is None and found[-2] == [] and not found[-3]

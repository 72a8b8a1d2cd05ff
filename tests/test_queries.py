"""Every query of the main catalog against its check SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from worklore.plans.catalog import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, message = compare.compare(spark, con, sf_dir, name)
    if message == "rows 0":  # nothing to compare here: the next larger tables must have rows
        larger = sf_dir.replace("sf0.001", "sf0.01")
        ok, message = compare.compare(spark, compare.duck(larger), larger, name)
    assert ok, message


def test_nearly_all_checked():
    assert set(CHECKS) <= set(QUERIES) <= set(entry.queries())
    assert sorted(set(QUERIES) - set(CHECKS)) == ["t05_file_chunks", "t06_code_chunks"]


def test_entry(spark):
    assert entry.entry(spark).columns

"""Run registered queries on Spark and DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


NAMES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def cell(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if os.environ.get("EXACT") and isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6f}".replace("-0.000000", "0.000000")
    if isinstance(value, int):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, str):
        return value
    return repr(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in data)


def duck(sf_dir):
    import duckdb

    from worklore.plans.standins import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, name):
    """(ok, message) for one query."""
    import __spark_entry__ as entry

    build, sql = entry.queries()[name], entry.oracle_sql().get(name)
    df = build(spark, sf_dir)
    types = dict(df.dtypes)
    got_cols, got = rows(df.columns, df.collect())
    if sql is None:
        return sum(got.values()) > 0, f"rows only: {sum(got.values())}"
    cur = con.execute(sql)
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    n = sum(want.values())
    for d in cur.description or []:
        kind = NAMES.get(str(d[1]), str(d[1]))
        if types.get(d[0]) not in (kind, None) and os.environ.get("EXACT"):
            print("\n## type", name, d[0], types.get(d[0]), kind)
    if got_cols != want_cols:
        return False, f"columns {got_cols} against {want_cols}"
    if got != want:
        return False, (
            f"rows {sum(got.values())} against {n}; only spark {list((got - want).items())[:3]}; "
            f"only duckdb {list((want - got).items())[:3]}"
        )
    return n > 0, f"rows {n}"


if __name__ == "__main__":
    from worklore.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    import __spark_entry__ as entry

    wanted = sys.argv[1:]
    names = [n for n in entry.queries() if not wanted or any(n.startswith(w) for w in wanted)]
    spark, con, bad = local_session("8"), duck(sf), 0
    for n in names:
        t0 = time.time()
        try:
            ok, msg = compare(spark, con, sf, n)
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        if not ok or os.environ.get("VERBOSE"):
            print("\n##", "ok  " if ok else "FAIL", n, f"{time.time() - t0:.1f}s", msg, flush=True)
    print(f"\n## {len(names) - bad} of {len(names)} ok")

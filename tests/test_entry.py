from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
SLOW = {"state_count_net_2", "pipeline"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def _value(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


def test_entry_returns_rows(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry_module.oracle_sql()) - SLOW))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry_module.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    frame = entry_module.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(columns)
    got = sorted((tuple(_value(r[c]) for c in sorted(columns)) for r in frame.collect()), key=repr)
    rows = sorted((tuple(_value(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in want.fetchall()), key=repr)
    assert got == rows

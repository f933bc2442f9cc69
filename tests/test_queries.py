"""Every query with SQL against DuckDB, on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gaugeworks.plans.registry import ORACLE_SQL, QUERIES

SF = entry.SMOKE_DIR


def values(rows):
    return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    other = con.sql(ORACLE_SQL[name])
    assert columns == sorted(other.columns)
    assert values(map(tuple, frame.select(*columns).collect())) == values(other.select(",".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_without_training_operators(spark, monkeypatch):
    monkeypatch.setattr(entry, "_module", lambda name: None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)

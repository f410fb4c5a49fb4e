"""Every query with SQL matches DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    tidy = lambda v: round(v, 3) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(names), sorted(repr([tidy(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

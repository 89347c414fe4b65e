"""Every query with SQL gives what the SQL gives."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from stratamill.plans.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(rows):
    fix = lambda x: float(f"{x:.9g}") if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_as_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours, theirs = QUERIES[name](spark, str(DATA)), con.sql(ORACLE[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert plain(ours.select(columns).collect()) == plain(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(entry.queries())

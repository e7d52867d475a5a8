"""Every query with SQL against DuckDB on the smallest tables; values compared as sorted text."""

import math
from pathlib import Path

import duckdb
import pytest

from sabermill.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(FOLDER))
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, str(FOLDER)).count() > 0

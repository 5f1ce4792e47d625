"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    value = lambda x: x if isinstance(x, (int, str, type(None))) else round(x, 6) if isinstance(x, float) else str(x)
    return sorted([tuple(map(value, r)) for r in rows], key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tables, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = tables.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [[r[names.index(c)] for c in columns] for r in found.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(expected)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())

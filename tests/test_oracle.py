"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from undula import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    """Rows with columns in order of name, in a fixed order."""
    names = sorted(frame.columns)
    clean = [tuple(None if v is None or isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame[names].astype(object).values.tolist()]
    return names, sorted(map(repr, clean))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    if name not in queries.ORACLES:
        assert len(got)
        return
    assert rows(got) == rows(duck.execute(queries.ORACLES[name]).df())

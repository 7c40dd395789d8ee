"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import json
import os
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tokensieve.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (float, np.floating)):
        return round(float(x), 5) + 0.0
    if isinstance(x, (int, np.integer, np.bool_)):
        return int(x)
    return x


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(json.dumps([plain(v) for v in r], default=str) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in catalogue.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

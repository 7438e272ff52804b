"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sparkloom.plans.catalogue import ORACLE_SQL, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _ordered(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)]
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name]).df()
        pd.testing.assert_frame_equal(_ordered(got), _ordered(want), check_dtype=False, rtol=1e-9, atol=1e-9)

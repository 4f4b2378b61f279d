"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
ORACLE_SF = "/root/testdata/sf0.01"


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


import __spark_entry__ as entry  # noqa: E402

from quire.plans.catalog import QUERIES as OWN  # noqa: E402

# the training-data queries have their own tests
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in OWN}
QUERIES = {k: v for k, v in entry.queries().items() if k in OWN}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    from quire.views import BASE_TABLES
    for t in BASE_TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sql = ORACLES[name].replace(ORACLE_SF, SF)   # file-listing oracles name their folder
    s = QUERIES[name](spark, SF).toPandas()
    d = con.execute(sql).df()
    sc, sr = _rows(s)
    dc, dr = _rows(d)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


@pytest.mark.sf01
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle_at_sf01(spark, name):
    """The same check at the scale of the bench: ``pytest -m sf01``."""
    big = "/root/testdata/sf0.1"
    c = duckdb.connect()
    from quire.views import BASE_TABLES
    for t in BASE_TABLES:
        c.execute(f"create view {t} as select * from '{big}/{t}.parquet'")
    s = QUERIES[name](spark, big).toPandas()
    d = c.execute(ORACLES[name].replace(ORACLE_SF, big)).df()
    (sc, sr), (dc, dr) = _rows(s), _rows(d)
    assert sc == dc and len(sr) == len(dr) and sr == dr


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

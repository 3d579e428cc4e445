"""The registered queries of the training-data operators against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from folioscope.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = queries.QUERIES[name](spark, data)
    res = con.sql(queries.ORACLES[name])
    assert sorted(res.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    want = sorted(str([r[res.columns.index(c)] for c in cols]) for r in res.fetchall())
    assert sorted(str(list(r)) for r in df.select(*cols).collect()) == want and want

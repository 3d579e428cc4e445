"""Every registered core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.plans import registry


def flat(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return str([flat(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def db(request):
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for p in glob.glob(f"{path}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, data, db, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted("|".join(flat(v) for v in r) for r in df.select(*cols).collect())
    if name in registry.ORACLES:
        res = db.sql(registry.ORACLES[name])
        names = res.columns
        assert sorted(names) == cols
        want = sorted("|".join(flat(r[names.index(c)]) for c in cols) for r in res.fetchall())
        assert got == want


def test_every_snapshot_is_compared_and_no_green_row_is_empty(spark, data):
    found = registry.QUERIES["recrawl_change_kinds"](spark, data)
    assert {r.snapshot_no for r in found.select("snapshot_no").distinct().collect()} == {2, 3, 4, 5, 6}
    for name in ("orphaned_embeddings", "mention_edges", "context_budget", "hybrid_recall", "frontier_status_counts"):
        assert registry.QUERIES[name](spark, data).limit(1).count() == 1, name


def test_entry_runs(spark, data):
    assert entry.entry(spark).limit(1).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver does the same at sf0.01); queries without an oracle must run."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from thali.plans import REGISTRY
from tools.oracle_check import compare, con_for

QUERIES = {k: q.build for k, q in REGISTRY.items()}
ORACLE = {k: q.oracle for k, q in REGISTRY.items() if q.oracle}


@pytest.fixture(scope="module")
def con():
    return con_for(SF_SMALL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.sql(ORACLE[key])
    err = compare(rows, df.columns, res.fetchall(), res.columns)
    assert err is None, err


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_orders"] > 0


def test_every_key_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)

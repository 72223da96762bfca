"""Every query with oracle SQL equals DuckDB on the smallest scale (driver-style compare)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, digest, family  # noqa: E402

from conftest import SMALL  # noqa: E402

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SMALL)
    scols = sdf.columns
    stypes = {f.name: family(f.dataType.simpleString()) for f in sdf.schema.fields}
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(ORACLES[name])
    dcols = rel.columns
    dtypes = {c: family(str(t)) for c, t in zip(dcols, rel.types)}
    drows = rel.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert stypes == dtypes
    assert len(srows) == len(drows)
    idx = [dcols.index(c) for c in scols]
    assert digest(srows, scols) == digest([tuple(r[i] for i in idx) for r in drows], scols)

"""Every registered query against its DuckDB oracle (row count, schema,
order-insensitive value hash), and rows-only queries for a stable schema."""

import duckdb
import pytest

import __spark_entry__ as E
from surv.plans import catalog
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, digest, spark_type

QUERIES = dict(catalog.QUERIES)   # the other queries have tests of their own
ORACLE = dict(catalog.ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_documented():
    rows_only = set(QUERIES) - set(ORACLE)
    assert set(ORACLE) <= set(QUERIES)
    assert rows_only <= {"k07_d12_schema_coverage"}, rows_only


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(ORACLE[name])
    ocols, otypes, orows = rel.columns, [str(t) for t in rel.types], rel.fetchall()
    assert sorted(zip(sdf.columns, [spark_type(f.dataType) for f in sdf.schema.fields])) == sorted(zip(ocols, otypes))
    assert len(srows) == len(orows)
    assert digest(sdf.columns, srows) == digest(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "incidence_100k" in df.columns

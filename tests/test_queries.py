"""Every terrain query against its DuckDB counterpart."""

import duckdb
import pytest

from voxelith.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    return connection


def _rows(frame):
    columns = sorted(frame.columns)
    out = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted((tuple(map(_plain, r)) for r in out.itertuples(index=False)), key=repr)


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    return round(float(value), 6)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    ours = _rows(registry.queries()[name](spark, SF).toPandas())
    theirs = _rows(oracle.execute(registry.oracle_sql()[name]).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())

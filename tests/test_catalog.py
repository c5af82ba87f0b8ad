"""Every registered trace query against its SQL equivalent."""

import math
from pathlib import Path

import duckdb
import pytest

from tracewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(catalog.ORACLES[name])
    wanted = rows([d[0] for d in result.description], result.fetchall())
    assert found[0] == wanted[0]
    assert len(found[1]) == len(wanted[1]) > 0
    assert found[1] == wanted[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0

"""Every registered query of the library against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from aeroframe.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.10g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == order
    at = [columns.index(c) for c in order]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall())


def test_corridors_follow_every_event(spark):
    from aeroframe.plans.domain import TELEMETRY
    from aeroframe.plans.queries_geometry import corridor_lines

    assert corridor_lines(spark, SF).count() == TELEMETRY.load(spark, SF).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered query of the reference's operators against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from folioflow.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 5) + 0.0 if isinstance(v, float) else str(v)


def rows(table):
    """Values by way of Arrow: pandas makes floats of one side's whole numbers with nulls, and not of the other's."""
    names = sorted(table.column_names)
    return names, sorted(str([plain(x) for x in r]) for r in zip(*[table.column(c).to_pylist() for c in names], strict=True))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_as_sql(name, spark, duck):
    a = registry.queries()[name](spark, DIR).toArrow()
    b = duck.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert rows(a) == rows(b)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.queries()) == set(registry.oracle_sql())

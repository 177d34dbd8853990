"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

import marlstone.catalogue as catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v if isinstance(v, (bool, int, type(None))) else str(v)


def rows_of(spark, name):
    df = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    return columns, sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def results(spark):
    """All queries, six at a time: most of a small query's time is spent waiting."""
    pool = ThreadPoolExecutor(6)
    yield {name: pool.submit(rows_of, spark, name) for name in sorted(catalogue.oracle_sql())}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(results, duck, name):
    columns, ours = results[name].result()
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert ours == sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=repr)

"""Queries of the training-data operators that SQL can express, against it."""

from pathlib import Path

import duckdb
import pytest

from marlstone.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    df = queries.queries()[name](spark, str(DATA))
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)

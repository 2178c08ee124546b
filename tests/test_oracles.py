"""Every registry query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from matchgrid.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(None if pd.isna(v) else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, isinstance(v, str), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got) > 0

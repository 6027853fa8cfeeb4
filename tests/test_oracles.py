"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from rollforge.plans import registry

registry.load()


def rows(pdf):
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "-"
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal":
            return repr(round(float(v), 6) + 0.0)
        return str(v)

    names = sorted(pdf.columns)
    return names, sorted(tuple(map(value, r)) for r in pdf[names].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())

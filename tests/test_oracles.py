"""Every query of the engine against SQL over the same tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from codestrata import oracles
from codestrata import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    tidy = lambda v: None if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v else round(float(v), 6) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v.item() if hasattr(v, "item") else v
    return sorted((tuple(tidy(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    found = own.QUERIES[name](spark, DATA).toPandas()
    if name in oracles.ORACLES:
        assert plain(found) == plain(duck.sql(oracles.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

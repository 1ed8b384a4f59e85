"""Every query of the catalogue that has SQL, against that SQL in DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from vintage.plans.queries import ORACLE_SQL, QUERIES
from vintage.sources.adapters import RAW

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if pd.isna(v) else str(v).replace(" 00:00:00", "") if not isinstance(v, (int, float)) else round(float(v), 7)
    return sorted((tuple(map(clean, r)) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)

"""Every query with SQL gives DuckDB's rows at sf0.01; every other one runs."""

import duckdb
import pandas as pd
import pytest

from plumbline import catalogue

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list[str]:
    def cell(v):
        if pd.isna(v):
            return None
        if isinstance(v, str):
            return v
        return int(v) if float(v).is_integer() else round(float(v), 6)

    names = sorted(df.columns)
    return sorted(str(tuple(cell(v) for v in r)) for r in df[names].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)

"""Every query with an oracle, against DuckDB at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(df):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, float):  # whole numbers beside nulls arrive as floats
            return int(v) if v.is_integer() else round(v, 9)
        return int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else v

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, row))) for row in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in SQL and not k.startswith("op") and k != "pipeline"))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

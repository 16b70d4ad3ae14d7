"""Every registered core query at the smallest scale, against its SQL where it has one."""

import os

import duckdb
import pandas as pd
import pytest

from loregrid.plans import catalog


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return ""
        return f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, folder, sql, name):
    got = catalog.queries()[name](spark, folder).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in catalog.oracle_sql():
        want = sql.execute(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got) > 0

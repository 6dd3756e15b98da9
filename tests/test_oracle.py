"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from wattloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(df):
    """(other columns as text, numbers) with the rows in the order of the texts, then the numbers."""
    df = df[sorted(df.columns)].copy()
    numbers = [c for c in df.columns if df[c].dtype.kind in "fiu" or str(df[c].dtype).startswith("Int")]
    for c in df.columns:
        if c in numbers:
            df[c] = df[c].astype(float).round(3) + 0.0
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda v: v.tolist() if hasattr(v, "tolist") else v).astype(str)
    df = df.sort_values([c for c in df.columns if c not in numbers] + numbers).reset_index(drop=True)
    return df.drop(columns=numbers), df[numbers]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    (got, x), (want, y) = canonical(registry.QUERIES[name](spark, SF).toPandas()), canonical(duck.execute(registry.SQL[name]).df())
    assert list(got.columns) == list(want.columns) and list(x.columns) == list(y.columns)
    assert len(got) == len(want)
    assert got.equals(want)
    # sums in another order may round a half to the other side: one last digit
    assert np.allclose(x, y, rtol=1e-9, atol=1.01e-3, equal_nan=True), (x[~np.isclose(x, y, equal_nan=True).all(axis=1)], y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

"""Every registered query with SQL gives the SQL's rows; every other one runs."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from geocadence.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT else (x if isinstance(x, (str, bool, int, float)) else str(x)[:10]))
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str).str[:10]
        elif str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(9) + 0.0
    out = df.astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None", "-0.0": "0.0"})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf_dir, duck, name):
    got, want = normal(catalog.queries()[name](spark, sf_dir).toPandas()), normal(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert np.all([callable(f) for f in e.queries().values()])

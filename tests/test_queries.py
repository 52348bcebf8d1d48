"""Every query against its SQL on the smallest tables, and the shape of those that have none."""

import os

import numpy as np
import pandas as pd
import pytest

from panelspark.plans import registry

duckdb = pytest.importorskip("duckdb")


def plain(df):
    """Rows as sorted tuples of texts, doubles to nine digits."""

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "-"
        if isinstance(v, (float, np.floating)):
            return f"{v + 0.0:.9g}"
        if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)):
            return f"{float(v):.9g}"
        return str(v).removesuffix(" 00:00:00")

    cols = sorted(df.columns)
    return cols, sorted(tuple(text(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def sql(small):
    c = duckdb.connect()
    for t in os.listdir(small):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{small}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, sql, name):
    got = registry.QUERIES[name](spark, small).toPandas()
    if name in registry.SQL:
        want = sql.execute(registry.SQL[name]).df()
        cols, rows = plain(got)
        assert cols == sorted(want.columns)
        assert rows == plain(want)[1]
    assert not got.duplicated(subset=[c for c in got.columns if not got[c].map(lambda v: isinstance(v, (list, np.ndarray, dict))).any()]).any()

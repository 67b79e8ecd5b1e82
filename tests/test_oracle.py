"""Queries against their SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from candlewick.plans import feature_queries, model_queries, panel_queries, quality_queries

SF = "/root/testdata/sf0.001"
MODULES = (feature_queries, panel_queries, quality_queries, model_queries)
CASES = [(m, n) for m in MODULES for n in m.ORACLE_SQL]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(df):
    """Columns and rows in one order; numbers as floats, all else as text."""
    out = {}
    for c in sorted(df.columns):
        x = df[c]
        if x.dtype.kind == "M":
            x = x.astype(str).replace("NaT", "")
        number = pd.to_numeric(x, errors="coerce")
        if number.notna().sum() == x.notna().sum() and (x.dtype.kind in "fiub" or x.notna().any()):
            out[c] = number.astype(float).round(6)
        else:
            out[c] = x.map(lambda v: "" if v is None or v is pd.NaT or v is pd.NA or v != v else str(v).replace(" 00:00:00", ""))
    return pd.DataFrame(out).sort_values(list(out), key=lambda s: s.astype(str), ignore_index=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query_equals_its_sql(spark, con, module, name):
    a = plain(module.QUERIES[name](spark, SF).toPandas())
    b = plain(con.execute(module.ORACLE_SQL[name]).fetch_df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f" and y.dtype.kind == "f":
            assert np.allclose(x, y, rtol=0, atol=2e-6, equal_nan=True), c
        else:
            blank = lambda s: ["" if pd.isna(v) or v in ("NaT", "None") else str(v) for v in s]
            assert blank(x) == blank(y), c

"""Every query with a DuckDB twin gives the twin's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from pluvio.plans import registry
from tests.conftest import SMALL

def rows(frame):
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return v
        if pd.isna(v):
            return None
        return round(v, 5) + 0.0 if isinstance(v, float) else v

    cols = sorted(frame.columns)
    return cols, sorted((tuple(repr(plain(v)) for v in r) for r in frame[cols].astype(object).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in registry.SQL if n not in registry.OTHER_NAMES])
def test_twin(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(registry.SQL[name]).df()
    got_cols, got_rows = rows(got)
    cols, want_rows = rows(want)
    assert got_cols == cols
    as_float = [tuple(_number(v) for v in r) for r in got_rows]
    assert sorted(as_float, key=str) == sorted((tuple(_number(v) for v in r) for r in want_rows), key=str)


def _number(text):
    try:
        return float(text)
    except ValueError:
        return text

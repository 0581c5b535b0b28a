"""Every query with SQL gives DuckDB's rows."""

import duckdb
import numpy as np
import pytest

from groundledger.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    v = v.tolist() if isinstance(v, np.ndarray) else v
    return [round(x, 6) if isinstance(x, float) else x for x in v] if isinstance(v, list) else v


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(plain)
        elif str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].dt.date
        elif frame[c].dtype.kind in "fi" or str(frame[c].dtype) == "Int64":
            frame[c] = frame[c].astype(float).round(6)
    return sorted(frame.astype(str).replace({"<NA>": "nan", "None": "nan"}).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

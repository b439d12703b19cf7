"""Every registered query of the engine against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        for frame in (got, want):  # whole numbers in a float column with nulls
            for c in frame.columns:
                if str(frame[c].dtype).startswith("float") and (frame[c].dropna() % 1 == 0).all():
                    frame[c] = frame[c].astype(object).map(lambda v: v if v is None or v != v else float(v))
                elif str(frame[c].dtype).startswith(("int", "Int")) and str(got[c].dtype).startswith("float"):
                    frame[c] = frame[c].astype(float)
        assert rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["wallet", "risk_score", "level"] and df.count() > 0

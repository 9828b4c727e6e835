import duckdb
import pytest

from kbflow.catalog import QUERIES, SQL


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(scope="module")
def db(sf):
    import glob
    from pathlib import Path

    own = duckdb.connect()
    own.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        own.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return own


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf), db.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    assert rows == sorted((tuple(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=key)


def test_the_rest_runs(spark, sf):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, sf).count() > 0

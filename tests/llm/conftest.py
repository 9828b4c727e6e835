import duckdb
import pytest


@pytest.fixture
def same(spark):
    """Compare a query with its SQL over a folder of tables."""

    def check(query, sql, folder, tables):
        db = duckdb.connect()
        for t in tables:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want = db.sql(sql)
        got = query(spark, folder)
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        key = lambda r: tuple((x is not None, x) for x in r)
        a = sorted((tuple(r[n] for n in names) for r in got.collect()), key=key)
        b = sorted((tuple(r) for r in want.project(", ".join(names)).fetchall()), key=key)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == y

    return check

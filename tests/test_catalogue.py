"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

from tablewright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    assert rows == sorted(map(str, want.fetchall()))


def test_entry(spark):
    assert catalogue.page_report(spark, SF).count() > 0

"""Each query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from strandframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {listed} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert ordered(map(tuple, df.select(*columns).collect())) == ordered(want)

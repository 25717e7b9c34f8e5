"""Every registered query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from helixframe.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    norm = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return cols, sorted((tuple(norm(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_like_sql(spark, sf, duck, name):
    assert rows(Q.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(Q.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL) - {"sv_calls"}))
def test_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_flagship(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "gt1" in out.columns

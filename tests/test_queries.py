"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from folioscope.plans import catalogue

QUERIES, SQL, EXAMPLES = catalogue.queries(), catalogue.oracle_sql(), catalogue.examples()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    same(duck, QUERIES[name](spark, sf), SQL[name])


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_examples(spark, sf, duck, name):
    query, sql = EXAMPLES[name]
    same(duck, query(spark, sf), sql)


def same(duck, df, sql):
    columns = sorted(df.columns)
    result = duck.execute(sql)
    order = [c[0] for c in result.description]
    assert sorted(order) == columns
    expected = [tuple(row[order.index(c)] for c in columns) for row in result.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    rows, again = QUERIES[name](spark, sf).collect(), QUERIES[name](spark, sf).collect()
    assert rows and plain(map(tuple, rows)) == plain(map(tuple, again))
    assert all(any(v is not None for v in r) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

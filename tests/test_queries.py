"""Every registered query that has SQL gives the same rows in Spark and DuckDB."""

import pytest

import __spark_entry__ as entry
from strandwork.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    found = duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    mine = sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=str)
    theirs = sorted(duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({queries.ORACLES[name]})").fetchall(), key=str)
    assert mine == theirs
    assert mine


def test_entry_module(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

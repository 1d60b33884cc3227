"""Every registered query with a DuckDB twin gives the twin's rows on the smallest tables."""

import os
import pathlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tallyforge.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in pathlib.Path(FOLDER).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    shown = lambda v: "NULL" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_like_the_twin(spark, duck, name):
    got, expected = catalog.queries()[name](spark, FOLDER).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_same_rows_for_any_partitioning(spark):
    from tallyforge.operators import leg_a
    from tallyforge.sources import world

    found = set()
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        w = world.derive(spark, FOLDER)
        d = catalog.flat_decisions(leg_a.reconcile(w.settlements, w.bank_rows, w.store)).toPandas()
        found.add(str(rows(d)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 1

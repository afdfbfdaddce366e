"""Every query of the library against its SQL in DuckDB, row by row."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sundew.plans import catalog


def rounded(row) -> tuple:
    return tuple(repr(float(f"{v:.9g}")) if isinstance(v, float) else repr(v) for v in row)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    made = catalog.queries()[name](spark, sf_dir)
    columns = sorted(made.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    places = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(places) == columns
    want = sorted(rounded(r[places[c]] for c in columns) for r in cursor.fetchall())
    assert sorted(rounded(r[c] for c in columns) for r in made.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    made = catalog.queries()[name](spark, sf_dir)
    assert made.columns
    made.collect()


def test_entry_has_the_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_can_be_listed_without_a_session():
    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr

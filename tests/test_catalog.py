"""Every query runs, and equals its SQL counterpart on the small sample tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import canonical

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="sample tables are not here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_names():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, db, name):
    frame = queries()[name](spark, str(FOLDER))
    result = db.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_has_rows(spark, name):
    assert not queries()[name](spark, str(FOLDER)).isEmpty()


def test_entry(spark):
    assert entry(spark).columns[:2] == ["well", "feature"]

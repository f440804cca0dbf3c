"""Every registered query against its DuckDB counterpart."""

import importlib.util
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from workload.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        connection.execute(f"create view {table.stem} as select * from '{table}'")
    return connection


def comparable(rows, columns):
    def plain(value):
        if isinstance(value, Decimal):
            return format(value.normalize(), "f")
        return format(value, ".9g") if isinstance(value, float) else value

    return sorted((tuple(plain(row[c]) for c in columns) for row in rows), key=str)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, str(DATA))
    result = duck.execute(entry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(names)
    expected = [dict(zip(names, row)) for row in result.fetchall()]
    assert expected
    assert comparable(frame.collect(), sorted(names)) == comparable(expected, sorted(names))


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query against its SQL oracle, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from joinseek.plans.oracles import ORACLES
from joinseek.plans.registry import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    found = queries()[name](spark, str(FOLDER))
    cursor = duck.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert normal([tuple(r) for r in found.collect()], found.columns) == normal(cursor.fetchall(), names)


def test_entry(spark):
    row = entry(spark).where("mergeable = 1").first()
    assert (row.left_columns, row.right_columns, row.join_score) == ("o_custkey", "c_custkey", 1.0)

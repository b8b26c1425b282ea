"""Every registered query against its checking SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from liftgauge.catalog.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def in_order(rows, columns):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted(
        (tuple(r[i] for i in place) for r in rows),
        key=lambda row: [(v is None, v if v is not None else 0) for v in row],
    )


@pytest.mark.parametrize("name", QUERIES)
def test_matches_the_checking_sql(spark, duck, name):
    frame = contract.queries()[name](spark, str(FOLDER))
    answer = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    expected = in_order(answer.fetchall(), columns)
    found = in_order([tuple(r) for r in frame.collect()], frame.columns)
    assert found == expected


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() == 23
    assert frame.columns == ["metric_order", "Metrics", "Pre", "Post", "Var", "Var%", "Sign"]

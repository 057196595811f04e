"""Every query with SQL against DuckDB; set VERSEMILL_SF for another scale."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, difference
from versemill.sources.songs import folder_names
from versemill.staging import scope, work_dir

SF = os.environ.get("VERSEMILL_SF", "/root/testdata/sf0.001")


# where a query has no rows at the small scale, as artists need fifteen songs
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connections():
    return {sf: connect(sf) for sf in {SF, LARGER}}


def compare(spark, connections, name, sf):
    """The difference, and what the query left in the work folder once its result was used."""
    before = set(folder_names(spark, staged_folder(spark)))
    with scope():
        found = difference(queries()[name](spark, sf), connections[sf], oracle_sql()[name])
    return found, set(folder_names(spark, staged_folder(spark))) - before


def staged_folder(spark):
    path = f"{work_dir(spark)}/versemill"
    os.makedirs(path, exist_ok=True)
    return path


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_result(spark, connections, name):
    found, left = compare(spark, connections, name, SF)
    assert not left
    if found == "no rows":
        found, left = compare(spark, connections, name, LARGER)
    assert found is None and not left


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0

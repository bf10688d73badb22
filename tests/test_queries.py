"""Every registered query against its SQL, on the smallest tables."""
import glob
import re

import pytest

import __spark_entry__ as contract
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SLOW = {"project_files", "raw_imports"}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in SLOW and n in contract.oracle_sql()])
def test_query(spark, connection, name):
    good, note = compare(contract.queries()[name](spark, FOLDER), connection, contract.oracle_sql()[name])
    assert good, note


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_query(spark, connection, name):
    good, note = compare(contract.queries()[name](spark, FOLDER), connection, contract.oracle_sql()[name])
    assert good, note


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["complexity"] >= rows[-1]["complexity"]


def test_no_lineage_shortcuts():
    """Lineage is cut by written tables, never by blocks that die with an executor."""
    for path in glob.glob("srcgraph/**/*.py", recursive=True):
        text = open(path, encoding="utf-8").read()
        assert not re.search(r"localCheckpoint|crossJoin|\.toPandas\(", text), path

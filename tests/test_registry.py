"""Every registered query against its SQL counterpart on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
import check_oracle

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_every_query_has_sql():
    assert set(entry.QUERIES) <= set(entry.queries())
    assert set(entry.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(FOLDER)


@needs_data
@pytest.mark.parametrize("name", entry.QUERIES)
def test_query_equals_sql(spark, con, name):
    assert check_oracle.compare(spark, con, FOLDER, name) == ""


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns[0] == "sampleID"

"""Every registered query against its SQL on the smallest tables."""

import warnings

import pytest

import __spark_entry__ as suite
import check
from ledgerline.suite.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(suite.queries())


def test_entry(spark):
    assert suite.entry(spark).columns == ["column", "mismatches"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert check.compare(spark, con, name, FOLDER) == ""

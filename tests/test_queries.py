"""Every registered query against its checking SQL, over whole tables."""

import os

import parity
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return parity.checker(SF_DIR)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, connection, key):
    df = QUERIES[key](spark, SF_DIR)
    if key in CHECKS:
        assert parity.compare(df, connection, CHECKS[key]) is None
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row["row_count"] > 0 and len(row["profile_fingerprint"]) == 64

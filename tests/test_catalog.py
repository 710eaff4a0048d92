"""Registered queries against their oracle SQL on the smallest data.

A few by default; all of them with WARDLOG_ALL_ORACLES=1.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"
QUICK = ("classify_http", "promote", "daily_top_values", "build_deny_lists", "accept_chain", "payload_hash")
NAMES = tuple(name for catalog in entry.CATALOGS for name in catalog.queries) if os.environ.get("WARDLOG_ALL_ORACLES") else QUICK
# Too few events at this scale for any address to try two names in an hour.
EMPTY = {"host_multi_username"}


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, oracle, name):
    problem = compare(entry.queries()[name], entry.oracle_sql()[name], spark, oracle, FOLDER)
    assert problem is None or (name in EMPTY and "empty" in problem)


def test_every_query_has_an_oracle():
    for catalog in entry.CATALOGS:
        assert set(catalog.queries) == set(catalog.oracles)


def test_entry(spark):
    assert entry.entry(spark).columns == ["day", "dimension", "value", "count", "rank"]

"""Every registered query against SQL on the same whole tables."""

from __future__ import annotations

import os

import pytest

import oracle
from tidewatch.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    ok, note = oracle.compare(spark, con, FOLDER, name, catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert ok, note


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0

"""Every registered query equals its SQL twin on whole tables, or at least runs."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import load
from checks.compare import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(load().queries))
def test_query(spark, name):
    good, message = compare(spark, SF_DIR, name, queries()[name], oracle_sql().get(name))
    assert good, message


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0

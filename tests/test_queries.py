"""Every registered query against its SQL twin, on the smallest tables.

All of them, with those that have no twin run to the end.
"""

from __future__ import annotations

import os

import pytest
from check_oracle import compare, oracle_connection

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
NAMES = list(entry_module.queries())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    good, note = compare(
        spark, duck, FOLDER, name, entry_module.queries()[name], entry_module.oracle_sql().get(name)
    )
    assert good, note


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())

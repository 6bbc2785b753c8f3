"""Every registered query against its SQL, on two scales."""

from __future__ import annotations

import pytest
from compare import assert_same
from conftest import DATA

import __spark_entry__ as entry_module
from stagetrail.plans.sample_queries import QUERIES
from stagetrail.plans.sample_sql import SQL


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name, scale):
    sf_dir = f"{DATA}/{scale}"
    assert_same(QUERIES[name](spark, sf_dir), duck(sf_dir), SQL[name])

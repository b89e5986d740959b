"""Registered queries against their SQL twins, on the smallest tables.

By default the headline queries and the first of each family; all of them with
``ALL_QUERIES=1`` (or ``tools/compare.py``, which reports every difference).
"""

import os

import pytest

import __spark_entry__ as entry
from evidentia.plans import catalog
from bench import HEADLINE
from tools.compare import compare, connect

from .conftest import SMALL



def chosen():
    names = sorted(catalog.queries())
    if os.environ.get("ALL_QUERIES"):
        return names
    families = {}
    for name in names:
        families.setdefault(name.split("_")[0], name)
    return sorted(set(HEADLINE) | set(families.values()))


pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="table set not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_a_twin():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_flagship_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["seq", "us", "category", "action", "summary"]
    assert rows.count() > 0


@pytest.mark.parametrize("name", chosen())
def test_query_matches_sql(spark, duck, name):
    _, _, verdict = compare(spark, duck, name, SMALL)
    assert verdict.startswith("ok"), verdict

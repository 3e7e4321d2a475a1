"""Registered queries against their SQL, and the driver's contract."""

import os

import pytest

from strandlake.plans import registry
from tests.parity import FOLDER, assert_same

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE[name])


@needs_tables
def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


@needs_tables
def test_lines_of_results(spark):
    lines = [r[0] for r in registry.QUERIES["tsv_lines"](spark, FOLDER).collect()]
    assert lines and all(len(x.split("\t")) == 8 for x in lines)

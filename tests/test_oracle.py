"""Every registered query with SQL against it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    result, _ = compare(spark, SMALL, registry.QUERIES[name], registry.SQL[name])
    assert result.startswith("ok"), result


def test_every_sql_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

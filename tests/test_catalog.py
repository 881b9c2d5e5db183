"""Every catalogue query against its SQL on the smallest data set."""

import pytest

from check_sql import compare
from tollgate.plans import catalog

catalog.load()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    good, text = compare(spark, sf_dir, name)
    assert good, text


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

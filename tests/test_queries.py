"""Every core query against its SQL, or for rows where SQL can't say it."""

from __future__ import annotations

import pytest
from conftest import compare

from tidemark.plans import queries as core

NAMES = list(core.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, name):
    run, sql = core.queries()[name], core.oracle_sql().get(name)
    if sql:
        compare(spark, data, run, sql)
    else:
        run(spark, data).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query of the subpackage against its SQL, or for rows where SQL can't say it."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import compare  # noqa: E402

from tidemark.llm import queries as llm  # noqa: E402

COLUMNS = {
    "p1_found": {"fetch_no": "bigint", "line_no": "int"}, "p2_found": {"fetch_no": "bigint", "line_no": "int"}, "p3_found": {"id_a": "bigint", "id_b": "bigint"},
    "p4_found": {"first_no": "bigint", "arrival_no": "bigint"}, "p5_found": {"fetch_no": "bigint"}, "p6_found": {"query_id": "bigint", "doc_id": "bigint"},
    "p7_found": {"fetch_no": "bigint", "lang": "string"}, "p8_found": {"doc_id": "bigint", "item_id": "bigint"}, "p9_found": {"source": "string"}, "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, data, name):
    run, sql = llm.queries()[name], llm.oracle_sql().get(name)
    if sql:
        compare(spark, data, run, sql)
    found = run(spark, data)
    if name in COLUMNS:
        assert dict(found.dtypes) == COLUMNS[name]
        assert found.count() == found.distinct().count()
    else:
        found.collect()

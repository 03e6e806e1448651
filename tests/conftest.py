from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    session = build_session("local[4]", 4, "4g")
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


def compare(spark, data: str, run, sql: str) -> None:
    """Rows of a query against DuckDB's for its SQL, order aside."""
    import duckdb

    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")

    def plain(value):
        if value is None or value != value:
            return "null"
        if isinstance(value, float):
            return round(value, 5)
        if isinstance(value, (list, tuple)):
            return tuple(map(plain, value))
        return value

    found = run(spark, data)
    names = sorted(found.columns)
    told = con.execute(sql)
    order = [d[0] for d in told.description]
    assert sorted(order) == names
    theirs = [tuple(plain(r[order.index(n)]) for n in names) for r in told.fetchall()]
    ours = [tuple(plain(r[n]) for n in names) for r in found.collect()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))

"""Deltas are published whole: a job that dies leaves the version before, and can be run again."""

from __future__ import annotations

import pytest

from tidemark.operators.store import DeltaStore
from tidemark.session import scratch_path


def test_publish_retry_compact(spark):
    store = DeltaStore(spark, scratch_path(spark, "store"))
    assert store.read("a") is None and store.manifest()["number"] == 0
    for k in range(3):
        dead = store.attempt()
        dead.write(spark.createDataFrame([(99, "dead")], "n int, s string"), "a")  # dies before it publishes
        assert store.read("a") is None if k == 0 else store.read("a").count() == k
        alive = store.attempt()
        alive.write(spark.createDataFrame([(k, "x")], "n int, s string"), "a")
        alive.write(spark.createDataFrame([], "m long"), "b")
        assert alive.read("a").count() == k + 1
        alive.publish()
    assert sorted(r["n"] for r in store.read("a").collect()) == [0, 1, 2] and store.read("b").count() == 0
    with pytest.raises(RuntimeError):
        alive.publish()
    store.compact("a", 1)
    assert sorted(r["n"] for r in store.read("a").collect()) == [0, 1, 2] and len(store.manifest()["tables"]["a"]["paths"]) == 1
    assert store.vacuum() == 6 and store.read("a").count() == 3


def test_torn_manifest(spark):
    store = DeltaStore(spark, scratch_path(spark, "store"))
    one = store.attempt()
    one.write(spark.range(2).selectExpr("id"), "a")
    one.publish()
    with open(store.path.removeprefix("file://") + "/manifest-000000002.json", "w") as out:
        out.write('{"number": 2, "tab')
    assert store.read("a").count() == 2
    two = store.attempt()
    two.write(spark.range(3).selectExpr("id"), "a")
    two.publish()
    assert store.read("a").count() == 5

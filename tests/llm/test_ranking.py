from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.leximin import leximin_ranking, spread_rank

SCHEMA = "query_id long, list_no int, doc_id long, score float, place string, pct int"


def brute(rows, up):
    best = {}
    for q, l, i, s, *_ in rows:
        if None in (q, l, i, s) or s != s:
            continue
        value = s if up.get(l, True) else -s
        best[q, l, i] = max(value, best.get((q, l, i), value))
    lists, items = defaultdict(dict), defaultdict(lambda: defaultdict(list))
    for (q, l, i), s in best.items():
        lists[q, l][i] = s
    count = defaultdict(int)
    for (q, l), own in lists.items():
        count[q] += 1
        for i, s in own.items():
            place = 1 + sum(t > s for t in own.values())
            items[q][i].append((len(own) - place + 1) / len(own))
    out = set()
    for q, own in items.items():
        arrays = sorted(((tuple([0.0] * (count[q] - len(v)) + sorted(v)), i) for i, v in own.items()), key=lambda x: ([-y for y in x[0]], x[1]))
        out |= {(q, i, k + 1) for k, (_, i) in enumerate(arrays)}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(q, l, rng.randrange(30), rng.choice([None, float("nan"), 1.0, 2.0, rng.random() * 10 ** (l * 3)]), "clash", 1) for q in (1, 2, 3) for l in range(4) for _ in range(40)]
    rows += [(9, 0, k, 1.0, "", 0) for k in range(300)]  # a large group, all ties
    rows += [(None, 0, 1, 1.0, "", 0), (1, None, 1, 1.0, "", 0), (1, 0, None, 1.0, "", 0), *rows[:5]]
    up = {0: True, 1: False, 3: None}
    ways = spark.createDataFrame([(k, v) for k, v in up.items()], "list_no int, higher_is_better boolean")
    found = leximin_ranking(spark.createDataFrame(rows, SCHEMA), ways)
    assert {(r["query_id"], r["doc_id"], r["place"]) for r in found.collect()} == brute(rows, {k: v is not False for k, v in up.items()})


def test_weak_scores_cant_be_masked(spark):
    rows = [(1, 0, 1, 1e9, "", 0), (1, 0, 2, 5.0, "", 0), (1, 0, 3, 4.0, "", 0), (1, 1, 1, 0.1, "", 0), (1, 1, 2, 0.2, "", 0), (1, 1, 3, 0.3, "", 0)]
    ways = spark.createDataFrame([], "list_no int, higher_is_better boolean")
    found = [r["doc_id"] for r in leximin_ranking(spark.createDataFrame(rows, SCHEMA), ways).orderBy("place").collect()]
    assert found[0] == 2
    assert leximin_ranking(spark.createDataFrame([], SCHEMA), ways).count() == 0


@pytest.mark.parametrize("ties", [True, False])
def test_spread_rank_of_one_large_group(spark, ties):
    df = spark.range(2000).select((F.col("id") % 7 == 0).cast("int").alias("g"), (F.col("id") * 37 % 500).alias("s"), "id")
    order = [F.col("s").desc()] if ties else [F.col("s").desc(), F.col("id").asc()]
    found = spread_rank(df, ["g"], order, "n", ties=[F.col("s").desc()] if ties else None, partitions=16)
    rows = found.collect()
    for g in (0, 1):
        own = [r for r in rows if r["g"] == g]
        if ties:
            assert all(r["n"] == 1 + sum(t["s"] > r["s"] for t in own) for r in own[::20])
        else:
            assert [r["id"] for r in sorted(own, key=lambda r: r["n"])] == [r["id"] for r in sorted(own, key=lambda r: (-r["s"], r["id"]))]

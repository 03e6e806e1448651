from __future__ import annotations

from pathlib import Path

import numpy as np

from tidemark.llm.neighbours import VantagePointNeighbours
from tidemark.session import shared_dir

SCHEMA = "rec_no long, doc_id long, embedding array<float>, id string, vec int"


def rows_of(matrix, start=0):
    return [(k, 100 + k, [float(x) for x in v], "clash", 1) for k, v in enumerate(matrix, start)]


def brute(rows, dims, k):
    vectors = {}
    for _, doc_id, v, *_ in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        if v is not None and len(v) == dims and None not in v and any(v) and doc_id not in vectors:
            vectors[doc_id] = np.array(v, np.float64) / np.linalg.norm(v)
    ids = sorted(vectors)
    matrix = np.stack([vectors[i] for i in ids])
    sims = matrix @ matrix.T
    out = set()
    for a, i in enumerate(ids):
        order = sorted((round(-sims[a, b], 9), j) for b, j in enumerate(ids) if j != i)
        out |= {(i, j) for _, j in order[:k]}
    return out


def pairs(df):
    return {(r["id"], r["neighbour"]) for r in df.collect()}


def clustered(n=1500, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12, dims))
    return (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, dims))).astype(np.float32)


def test_factor_one_is_exact(spark):
    rows = rows_of(clustered())
    found = VantagePointNeighbours(16, 5, factor=1.0, shard=300, sample=400).neighbours(spark.createDataFrame(rows, SCHEMA))
    assert pairs(found) == brute(rows, 16, 5)


def test_recall_of_relaxed_search(spark):
    rows = rows_of(clustered(3000, 64))
    found = pairs(VantagePointNeighbours(64, 5, shard=512).neighbours(spark.createDataFrame(rows, SCHEMA)))
    true = brute(rows, 64, 5)
    assert len(found & true) / len(true) > 0.95 and len(found) == len(true)


def test_dirty_vectors_and_copies(spark):
    rows = rows_of(clustered(80, 16))
    first = rows[0][2]
    rows += [(500 + k, 900 + k, first if k % 2 else [2 * x for x in first], "", 0) for k in range(30)]  # a large group of copies
    rows += [(600, 101, [1.0] * 16, "", 0), (601, 7, None, "", 0), (602, 8, [0.0] * 16, "", 0), (603, 9, [1.0] * 5, "", 0), (604, None, [1.0] * 16, "", 0),
             (605, 10, [1.0] * 15 + [None], "", 0), (606, 11, [float("nan")] * 16, "", 0)]
    found = pairs(VantagePointNeighbours(16, 5, factor=1.0, shard=32).neighbours(spark.createDataFrame(rows, SCHEMA)))
    clean = [r for r in rows if r[1] != 11]
    assert found == brute(clean, 16, 5)


def test_few_and_none(spark):
    rows = rows_of(clustered(40, 16)[:3])
    assert len(pairs(VantagePointNeighbours(16, 5).neighbours(spark.createDataFrame(rows, SCHEMA)))) == 6
    assert VantagePointNeighbours(16, 5).neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert VantagePointNeighbours(16, 5).neighbours(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0


def test_near_copies_are_exact_at_factor_one(spark):
    """Clusters of vectors whose angles are far below single precision's, over several shards."""
    rng = np.random.default_rng(8)
    for angle in (1e-6, 1e-4, 1e-2):
        centres = rng.standard_normal((12, 32))
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        step = rng.standard_normal((360, 32))
        matrix = centres[rng.integers(0, 12, 360)] + angle * step / np.linalg.norm(step, axis=1, keepdims=True)
        rows = rows_of(matrix)
        found = VantagePointNeighbours(32, 5, factor=1.0, shard=64, sample=200, queries=40).neighbours(spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>")))
        ids = np.arange(100, 460)
        unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        sims = np.round(unit @ unit.T, 12)
        np.fill_diagonal(sims, -2)
        true = {(ids[a], ids[b]) for a, order in enumerate(np.argsort(-sims, axis=1, kind="stable")[:, :5]) for b in order}
        assert pairs(found) == true, angle


def test_ties_go_to_the_smaller_id(spark):
    """Forty vectors as far from one another as from every other."""
    matrix = np.eye(40)
    found = pairs(VantagePointNeighbours(40, 5, factor=1.0, shard=8, sample=40).neighbours(spark.createDataFrame(rows_of(matrix), SCHEMA)))
    assert found == {(a, b) for a in range(100, 140) for b in [x for x in range(100, 140) if x != a][:5]}


def test_vectors_are_sent_in_rounds_and_no_table_of_them_stays(spark):
    rows = rows_of(clustered(dims=128))
    folder = Path(shared_dir(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = size()
    found = VantagePointNeighbours(128, 5, factor=1.0, shard=100, sample=400, room=1.0).neighbours(spark.createDataFrame(rows, SCHEMA))
    assert size() - before < len(rows) * 128 * 4
    assert pairs(found) == brute(rows, 128, 5)

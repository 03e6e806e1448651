from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import index as ix
from tidemark.operators import search as se
from tidemark.operators.store import Attempt
from tidemark.plans.engine import SearchEngine
from tidemark.session import scratch_path

SCHEMA = "doc_id long, url string, title string, body string, headings array<string>, meta_description string, extra int"


def docs(spark, ids):
    body = "the harbour map shows every quiet lane near the old mill and the river. number {0} is told here in full sentences today."
    return spark.createDataFrame([(i, f"https://s{i}.example/p", f"Page {i}", body.format(i), ["Head"], None, 1) for i in ids], SCHEMA)


def test_append_ignores_known(spark):
    index = ix.Index(spark, scratch_path(spark, "index"))
    index.add(docs(spark, [1, 2, 2]))
    index.add(docs(spark, [2, 3]))
    assert sorted(r[0] for r in index.table("docstore").select("doc_id").collect()) == [1, 2, 3]
    assert index.stats().first()["n_docs"] == 3
    engine = SearchEngine.open(index)
    assert engine.search("harbour", "text", 10).count() == 3
    assert [r["doc_id"] for r in engine.search("harbour", "text", 2, offset=1).collect()] == [2, 3]
    assert engine.suggest("h").count() == 0 and engine.suggest("harbour", 2).count() == 2


def test_empty(spark):
    posts = ix.postings(docs(spark, []), {"title": 3, "headings": 2, "body": 1})
    stats = ix.corpus_stats(ix.lengths(posts)).first()
    assert (stats["n_docs"], stats["avg_len"]) == (0, 0.0)
    assert se.bm25_scores(posts, ix.lengths(posts), ix.corpus_stats(ix.lengths(posts)), []).count() == 0


def test_batch_nearest_equals_single(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [(99, None), (98, [1.0])], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id in (3, 4)").selectExpr("vec_id as query_id", "embedding")
    found = se.nearest_batch(rows, asked, 4, block=1)
    for q in (3, 4):
        vector = rows.where(f"vec_id = {q}").first()["embedding"]
        one = [(r["vec_id"], r["score"]) for r in se.nearest(rows, vector, 4).collect()]
        many = [(r["vec_id"], r["score"]) for r in found.where(f"query_id = {q}").orderBy("score", ascending=False).collect()]
        assert sorted(one) == sorted(many)


def unit_vectors(n=600, dims=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dims))
    points = centres[rng.integers(0, 20, n)] + 0.4 * rng.standard_normal((n, dims))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def test_cells_recall_against_all(spark):
    """Every fiftieth vector against all others, by cells and exactly."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding")
    centres = se.fit_cells(e, 32)
    near = {(r["query_id"], r["vec_id"]) for r in se.nearest_cells_batch(se.assign_cells(e, centres, "vec_id"), centres, asked, 5).collect()}
    true = {(r["query_id"], r["vec_id"]) for r in se.nearest_batch(e, asked, 5).collect()}
    assert len(near) == len(true) and len(near & true) >= 0.9 * len(true)


def test_vectors_are_appended_to_cells(spark):
    points = unit_vectors()
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)] + [(900, None), (901, [1.0]), (None, [0.0] * 16)], "doc_id long, embedding array<double>")
    index = ix.Index(spark, scratch_path(spark, "index"))
    index.add(docs(spark, range(600)))
    index.add_vectors(rows.where("doc_id < 300 or doc_id is null"), cells=12)
    index.add_vectors(rows.where("doc_id >= 250"))
    index.compact()
    assert index.table("vectors").count() == 600 and {r[0] for r in index.table("vectors").select("doc_id").collect()} == set(range(600))
    engine = SearchEngine.open(index)
    hits = total = 0
    for q in range(0, 600, 50):
        found = [r["doc_id"] for r in engine.search("", "semantic", 5, query_vector=[float(x) for x in points[q]]).collect()]
        true = {r["doc_id"] for r in se.nearest(rows.where("doc_id < 600"), list(points[q]), 5, key="doc_id").collect()}
        hits, total = hits + len(true & set(found)), total + 5
        assert found[0] == q
    assert hits >= 0.9 * total


def test_append_that_died_is_run_again(spark, monkeypatch):
    index = ix.Index(spark, scratch_path(spark, "index"), stemmer="snowball")
    index.add(docs(spark, [1]))
    whole = Attempt.write

    def dies(self, df, table):
        if table == "docstore":
            raise RuntimeError("lost")
        return whole(self, df, table)

    monkeypatch.setattr(Attempt, "write", dies)
    with pytest.raises(RuntimeError):
        index.add(docs(spark, [2]))
    monkeypatch.setattr(Attempt, "write", whole)
    assert index.table("postings").select("doc_id").distinct().count() == 1
    index.add(docs(spark, [2]))
    assert index.stats().first()["n_docs"] == 2
    assert SearchEngine.open(index).search("harbours", "text", 5).count() == 2  # asked for by its stem

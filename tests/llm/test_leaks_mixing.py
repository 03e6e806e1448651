from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.leaks import LeakFinder, align
from tidemark.llm.mixing import SourceMixer, split_blocks
from tidemark.llm.queries import VOCABULARY

DOCS = "doc_id long, text string, item_id string, score int"
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, run=10):
    out = set()
    for d, text, *_ in docs:
        own = words(text)
        there = {tuple(own[k : k + run]) for k in range(len(own) - run + 1)}
        for i, item, *_ in items:
            theirs = words(item)
            if d is not None and i is not None and any(tuple(theirs[k : k + run]) in there for k in range(len(theirs) - run + 1)):
                out.add((d, i))
    return out


def made(seed=8):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(["Choose", "the", "best", "answer", "for"] + text(rng.randrange(12, 30))), "clash") for k in range(25)]
    items += [(100, items[0][1], ""), (101, None, ""), (102, "", ""), (103, "too short", ""), (None, items[1][1], "")]
    docs = []
    for k in range(120):
        own = text(rng.randrange(40, 160))
        if k % 3 == 0:
            source = words(items[rng.randrange(25)][1])
            n = rng.choice([8, 9, 10, 11, len(source)])
            start = rng.randrange(max(1, len(source) - n + 1))
            at = rng.randrange(len(own))
            own[at:at] = source[start : start + n]
        docs.append((k, (", " if k % 2 else " ").join(own).upper(), "clash", 1))
    docs += [(200, None, "", 0), (201, "", "", 0), (None, items[0][1], "", 0), docs[0], (202, " ".join(text(60_000)) + " " + items[3][1], "", 0)]
    return docs, items


def test_runs_equal_brute_force(spark):
    docs, items = made()
    found = LeakFinder().find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert {(r["doc_id"], r["item_id"]) for r in found.where("run >= 10").collect()} == brute(docs, items)


def test_blocks_of_items(spark):
    docs, items = made(9)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one, many = LeakFinder().find(d, i), LeakFinder(block_words=150).find(d, i)
    key = lambda df: {(r["doc_id"], r["item_id"]) for r in df.where("run >= 10").collect()}
    assert key(one) == key(many)
    assert LeakFinder().find(d, i.limit(0)).count() == 0 and LeakFinder().find(d.limit(0), i).count() == 0


def test_edited_copy_is_scored(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    edited = "x y alpha beta gamma delta epsilon zeta new eta theta iota lambda mu nu xi z"
    found = LeakFinder().find(spark.createDataFrame([(1, edited, "", 0)], DOCS), spark.createDataFrame([(7, item, "")], ITEMS)).collect()
    assert len(found) == 1 and found[0]["run"] == 6 and 0.8 < found[0]["score"] < 1


def test_edited_copies_of_revised_items(spark):
    """An edited copy of what two items share is found, whatever else the corpus holds and however items are blocked."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    items = [(7, item, ""), (8, item.replace("nu xi", "rho sigma"), "")]
    edited = "x y alpha beta gamma delta epsilon zeta new eta theta iota lambda mu nu xi z"
    docs = [(1, edited, "", 0), (2, "alpha beta gamma delta stop", "", 0)]
    key = lambda d, **k: {(r["doc_id"], r["item_id"]) for r in LeakFinder(**k).find(spark.createDataFrame(d, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert key(docs) == {(1, 7), (1, 8)} == key(docs, block_words=10)
    assert key([*docs, (3, item, "", 0)]) == {(1, 7), (1, 8), (3, 7), (3, 8)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.lists(st.integers(0, 3), max_size=20))
def test_alignment(a, b):
    """Against the textbook recurrence."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    run = np.zeros_like(h)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            run[i, j] = run[i - 1, j - 1] + 1 if x == y else 0
    score, _, longest = align(np.array(a, np.uint64), np.array(b, np.uint64))
    assert (score, longest) == (h.max(), run.max())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5))
def test_tree_spends_every_block(quota, shards, seed):
    leaves = split_blocks(np.array(quota), shards, seed)
    assert (leaves.sum(axis=0) == quota).all() and leaves.min() >= 0
    sizes = leaves.sum(axis=1)
    assert sizes.max() - sizes.min() <= 1
    assert (leaves == split_blocks(np.array(quota), shards, seed)).all()


def test_mix(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["Web", " web", "WEB ", "web"]), "a few words in one text " * rng.randrange(1, 9), 1) for k in range(600)]
    rows += [(1000 + k, "small", "other words in another text " * 4, 1) for k in range(40)] + [(2000, "elsewhere", "not a target", 1), (2001, None, "no source", 1), (2002, "web", None, 1), (2003, "web", "", 1), (None, "web", "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("web", 0.6, 1, "x"), ("small", 0.3, 2, "x"), ("absent", 0.1, 3, "x")], "source string, target_share double, max_repeats int, block string")
    mixer = SourceMixer(VOCABULARY, shards=4, max_blocks=200)
    report = {r["source"]: r for r in mixer.plan(docs, targets)[0].collect()}
    assert report["absent"]["short"] and report["small"]["short"] and not report["web"]["short"]
    assert report["small"]["drawn"] == 2 * report["small"]["available"]
    assert abs(report["web"]["share_of_total"] - 0.6) < 0.02
    mixed = mixer.mix(docs, targets).collect()
    for source, most in (("web", 1), ("small", 2)):
        own = [r["doc_id"] for r in mixed if r["source"] == source]
        assert max(own.count(i) for i in set(own)) == most
        assert sum(r["tokens"] for r in mixed if r["source"] == source) == report[source]["drawn"]
    assert {r["shard"] for r in mixed} == {0, 1, 2, 3}
    assert mixer.mix(docs.limit(0), targets).count() == 0
    assert {r["source"] for r in mixer.plan(docs.limit(0), targets)[0].collect()} == {"web", "small", "absent"}

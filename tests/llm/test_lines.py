from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from tidemark.llm.lines import SourceLineIndex
from tidemark.operators.store import Attempt
from tidemark.session import materialize

SCHEMA = "fetch_no long, domain string, body string, row_id int, line string"


def brute(rows):
    seen, size = defaultdict(set), defaultdict(set)
    key = lambda line: " ".join(re.findall(r"[^\W_]+", re.sub(r"\d+", "0", line.lower())))
    for fetch_no, domain, body, *_ in rows:
        if fetch_no is None:
            continue
        size[domain].add(fetch_no)
        for line in (body or "").split("\n"):
            if key(line):
                seen[domain, key(line)].add(fetch_no)
    flagged = {k for k, v in seen.items() if len(v) >= 4 and len(v) >= 0.1 * len(size[k[0]])}
    return {(f, n) for f, domain, body, *_ in rows if f is not None for n, line in enumerate((body or "").split("\n")) if (domain, key(line)) in flagged}


def made(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        domain = rng.choice(["a", "a", "a", "b", "c", None])
        lines = [f"text {rng.random()} {k} x{rng.randrange(10**6)}y" for _ in range(rng.randrange(4))]
        lines += [rng.choice(["Share this!", "  SHARE  this", "Updated 12 days ago", "Updated 9 days ago", "", "***", "Über uns", "rare line"]) for _ in range(rng.randrange(3))]
        rng.shuffle(lines)
        rows.append((k, domain, "\n".join(lines), 7, "clash"))
    return rows + [(n, "a", None, 1, None), (n + 1, "a", "", 1, None), (None, "a", "Share this!", 1, None), (n + 2, "a", "word " * 50_000 + "\nShare this!", 1, None)]


def found(index):
    return {tuple(r) for r in index.occurrences().collect()}


def test_equals_brute_force(spark):
    rows = made()
    index = SourceLineIndex(spark)
    index.merge(spark.createDataFrame(rows, SCHEMA))
    assert found(index) == brute(rows)


def test_deltas_equal_one_merge(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    index = SourceLineIndex(spark)
    for part in (df.where("fetch_no < 80 or fetch_no is null"), df.where("fetch_no >= 60 and fetch_no < 150"), df.where("fetch_no >= 150")):
        index.merge(part)  # the second overlaps the first: known rows are ignored
    assert found(index) == brute(rows)


def test_only_changed_rows_are_rebuilt(spark):
    first = [(k, "a", f"own {k} q{k}w\nBYLINE", 1, "") for k in range(3)] + [(k, "b", f"else {k}", 1, "") for k in range(10, 13)]
    index = SourceLineIndex(spark)
    assert index.merge(spark.createDataFrame(first, SCHEMA)).count() == 0
    changed = index.merge(spark.createDataFrame([(20, "a", "byline.", 1, "")], SCHEMA))
    assert {r[0] for r in changed.collect()} == {0, 1, 2, 20}
    many = [(100 + k, "a", f"plain {'z' * (k + 1)}", 1, "") for k in range(60)]
    assert {r[0] for r in index.merge(spark.createDataFrame(many, SCHEMA)).collect()} == {0, 1, 2, 20}  # under a tenth now
    assert found(index) == set()


def test_clean_and_empty(spark):
    rows = [(k, "a", f"top\nown {'x' * (k + 1)}\ntop", 1, "") for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = SourceLineIndex(spark)
    index.merge(df)
    assert {r["body"] for r in index.clean(df).collect()} == {f"own {'x' * (k + 1)}" for k in range(5)}
    assert index.clean(df).columns == df.columns
    empty = SourceLineIndex(spark)
    empty.merge(df.limit(0))
    assert found(empty) == set()


def test_repeated_rows_count_once(spark):
    rows = [(1, "a", "same", 1, ""), (1, "a", "same", 1, ""), (2, "a", "same", 1, ""), (3, "a", "same", 1, "")]
    index = SourceLineIndex(spark)
    index.merge(spark.createDataFrame(rows, SCHEMA))
    assert found(index) == set()


def test_rebuild_and_lost_merge(spark, monkeypatch):
    rows = [r for r in made(seed=3) if r[0] is not None]
    df, index, built = spark.createDataFrame(rows, SCHEMA), SourceLineIndex(spark), None
    whole = Attempt.write

    def dies(self, table_df, table):
        if table == "verdicts":
            raise RuntimeError("lost")
        return whole(self, table_df, table)

    for end in (70, 140, 10**6):
        until = df.where(f"fetch_no < {end}")
        monkeypatch.setattr(Attempt, "write", dies)
        with pytest.raises(RuntimeError):
            index.merge(until)
        monkeypatch.setattr(Attempt, "write", whole)
        changed = index.merge(until)
        built = materialize(index.rebuild(until, built, changed), "built")
        index.compact()
    assert found(index) == brute(rows)
    assert sorted(map(tuple, built.collect()), key=str) == sorted(map(tuple, index.clean(df).collect()), key=str)

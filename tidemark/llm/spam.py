"""Keyword-stuffed and link-list pages (problem 10).

Each document becomes a point of five features, each larger for spam: density of list-like text,
lack of entropy, repetition, lack of function words, links. Per language a robust centre and scatter
(medians, then the covariance of the nearest half, twice) give each point its Mahalanobis distance.
An outlier is flagged if it lies in a spam direction: that is from the language's centre towards a page
of nothing but keywords, of nothing but links, or of one phrase said over and over, and nearer, by the
same distance, to such a page than to the centre.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Container, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

_WORD = re.compile(r"[^\W_]+")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+(?:/\S*)?\b")
_DOT = re.compile(r"[^\W\d_]\.[^\W\d_]")
_STOP = re.compile(r"(?<=[.!?…])\s+")
FEATURES = ["density", "sameness", "repetition", "bareness", "links"]
#: Pages of nothing but spam: keywords, links, one phrase. Features that aren't named are the language's usual ones.
POLES = [{"density": 1.0, "bareness": 1.0}, {"density": 1.0, "bareness": 1.0, "links": 1.0}, {"repetition": 1.0, "sameness": 0.5}]


def _phrases(words: list[str], function: Container[str]) -> list[bool]:
    """The part of ``repeated`` that holds for phrases of any length."""
    inside = [False] * len(words)
    fours = list(zip(words, words[1:], words[2:], words[3:]))
    often = {f for f, n in Counter(fours).items() if n >= 5 and not all(w in function for w in f)}
    if not often:
        return inside
    covered, places = [0] * len(words), {}
    for k, four in enumerate(fours):
        if four in often:
            covered[k : k + 4] = [1] * 4
            places.setdefault(four, []).append(k)
    before = [0, *accumulate(covered)]
    for at in places.values():
        first = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or 5 * (before[at[k]] - before[at[k - 1]]) < 4 * (at[k] - at[k - 1]):
                if k - first >= 5:
                    inside[at[first] : at[k - 1] + 4] = [True] * (at[k - 1] + 4 - at[first])
                first = k
    return inside


def repeated(words: list[str], function: Container[str]) -> list[bool]:
    """For each word whether it stands in a phrase repeated over and over.

    That is a run of at least five occurrences of a pair of words, not both function words, with at
    most six words between one and the next; or of four words, with any number of words between, most
    of which stand in such fours too.
    """
    inside = _phrases(words, function)
    pairs = Counter(zip(words, words[1:]))
    often = {p for p, n in pairs.items() if n >= 5 and not (p[0] in function and p[1] in function)}
    if not often:
        return inside
    runs: dict[tuple[str, str], list[int]] = {}
    for k, pair in enumerate(zip(words, words[1:])):
        if pair not in often:
            continue
        run = runs.get(pair)
        if run and k - run[-1] <= 8:
            run.append(k)
        else:
            if run and len(run) >= 5:
                inside[run[0] : run[-1] + 2] = [True] * (run[-1] + 2 - run[0])
            runs[pair] = [k]
    for run in runs.values():
        if len(run) >= 5:
            inside[run[0] : run[-1] + 2] = [True] * (run[-1] + 2 - run[0])
    return inside


def features(text: str | None, function: dict[str, tuple[str, ...]]) -> tuple | None:
    """(language, the five features, share of words in lists or repetition), or null without words.

    ``function`` has the languages of each function word.
    """
    if not text:
        return None
    words, listed, linked = [], [], 0
    is_function = function.__contains__
    for line in text.lower().split("\n"):
        links = _LINK.findall(line) if _DOT.search(line) else []
        inside = sum(len(_WORD.findall(x)) for x in links)
        linked += inside
        rest = _WORD.findall(_LINK.sub(" ", line)) if links else None
        # An address with a few words about it is an entry of a link list.
        if links and inside >= 3 * len(links) and len(rest) <= 12 * len(links):
            own = _WORD.findall(line)
            words += own
            listed += [True] * len(own)
            continue
        for piece in _STOP.split(line):
            own = _WORD.findall(piece)
            if own:
                # What doesn't end like a sentence needs more function words to count as one.
                bare = sum(map(is_function, own)) < (0.15 if piece.rstrip()[-1:] in ".!?…" else 0.3) * len(own)
                words += own
                listed += [bare] * len(own)
    n = len(words)
    if not n:
        return None
    again = repeated(words, function)
    counts = Counter(words)
    hits: Counter = Counter()
    functions = 0
    for word in filter(is_function, counts):
        c = counts[word]
        functions += c
        for code in function[word]:
            hits[code] += c
    code = max(hits, key=lambda x: (hits[x], x)) if hits else "?"
    if not hits or hits[code] < 0.05 * n:
        code = "?"
    entropy = (math.log(n) - sum([c * math.log(c) for c in counts.values() if c > 1]) / n) / math.log(n) if n > 1 else 1.0
    share = sum(a or b for a, b in zip(listed, again)) / n
    return code, sum(listed) / n, 1 - entropy, sum(again) / n, 1 - functions / n, linked / n, share


class SpamFinder:
    """Finds documents of keywords, links or one repeated phrase.

    Parameters: ``functions`` words of a language at most, each in ``function_share`` of its
    documents; a language needs ``enough`` labelled documents; ``quantile``: the squared distance from
    which a point is an outlier (chi-square with five degrees, 0.999: 20.5).

    Defined results: null texts and texts without words are no spam; documents of no known language
    are measured against those of all languages; a group of equal points has no outlier but those unequal to it; repeated ids are
    judged apart and given once; null ids are ignored; other columns are not read.
    """

    def __init__(self, functions: int = 150, function_share: float = 0.12, enough: int = 20, quantile: float = 20.5):
        self.functions, self.function_share, self.enough, self.quantile = functions, function_share, enough, quantile

    def function_words(self, docs: DataFrame) -> dict[str, frozenset[str]]:
        """Words in a large share of all documents of each labelled language: bounded by languages x ``functions``."""
        labelled = docs.select(F.lower(F.trim("lang")).alias("lang"), "text").where("lang is not null and text is not null and lang <> ''")

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                total: dict[str, Counter] = {}
                for lang, text in zip(batch["lang"], batch["text"]):
                    own = total.setdefault(lang, Counter())
                    own.update(set(_WORD.findall(text.lower())))
                    own[""] += 1  # the documents
                yield pd.DataFrame([(a, w, n) for a, own in total.items() for w, n in own.items()], columns=["lang", "word", "n"])

        counts = materialize(labelled.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "counts")
        sizes = counts.where("word = ''").select("lang", F.col("n").alias("docs"))
        large = sizes.where(F.col("docs") >= self.enough)  # one row a label in use
        common = counts.where("word <> ''").join(F.broadcast(large), "lang").where(F.col("n") >= self.function_share * F.col("docs"))
        out: dict[str, list[tuple[int, str]]] = {}
        for lang, word, n in common.select("lang", "word", "n").collect():  # at most 1 / function_share x words of a document each
            out.setdefault(lang, []).append((-n, word))
        return {lang: frozenset(w for _, w in sorted(words)[: self.functions]) for lang, words in out.items()}

    def points(self, docs: DataFrame) -> DataFrame:
        """(doc_id, lang, five features, share)."""
        function = self.function_words(docs)
        languages: dict[str, tuple[str, ...]] = {}
        for code in sorted(function):
            for word in function[code]:
                languages[word] = (*languages.get(word, ()), code)
        shared = docs.sparkSession.sparkContext.broadcast(languages)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            for batch in batches:
                out = [(i, *f) for i, text in zip(batch["doc_id"], batch["text"]) if (f := features(text, known))]
                yield pd.DataFrame(out, columns=["doc_id", "lang", *FEATURES, "share"])

        schema = "doc_id long, lang string, " + ", ".join(f"{c} double" for c in FEATURES) + ", share double"
        return materialize(docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(run, schema), "points")

    def distances(self, points: DataFrame) -> DataFrame:
        """``points`` with ``d2``, the squared robust distance from the centre, and ``toward``, how far on the way to the nearest kind of spam."""
        k = len(FEATURES)
        spark = points.sparkSession
        medians = {r["lang"]: np.array([r[f"m{i}"] for i in range(k)]) for r in
                   points.groupBy("lang").agg(*[F.percentile_approx(c, 0.5, 10000).alias(f"m{i}") for i, c in enumerate(FEATURES)]).collect()}
        # Documents of no known language are mostly spam themselves: they are measured against the
        # documents of all known languages, and against each other only if there are no others.
        known = [lang for lang in medians if lang != "?"]
        if known and "?" in medians:
            medians["?"] = np.median([medians[lang] for lang in known], axis=0)
        model = {lang: (m, np.eye(k) / 0.05**2) for lang, m in medians.items()}
        for _ in range(2):
            scored = self._scored(points, model)
            halves = {r["lang"]: r["h"] for r in scored.groupBy("lang").agg(F.percentile_approx("d2", 0.5, 10000).alias("h")).collect()}
            table = spark.createDataFrame(list(halves.items()), "lang string, h double") if halves else None
            if table is None:
                break
            near = scored.join(F.broadcast(table), "lang").where("d2 <= h")
            moments = near.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(FEATURES)],
                                               *[F.sum(F.col(a) * F.col(b)).alias(f"q{i}_{j}") for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if j >= i])
            model = {}
            sums = {r["lang"]: (r["n"], np.array([r[f"s{i}"] for i in range(k)]),
                                np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])) for r in moments.collect()}
            if known and "?" in sums:
                sums["?"] = tuple(sum(sums[lang][part] for lang in known) for part in range(3))
            for lang, (n, first, second) in sums.items():
                mean = first / n
                cov = second / n - np.outer(mean, mean)
                # The nearest half understates the scatter (2.2 makes up for it with five normal
                # features), and a feature that never varies gets a floor.
                model[lang] = (mean, np.linalg.inv(2.2 * cov + 0.03**2 * np.eye(k)))
        return self._scored(points, model)

    @staticmethod
    def _scored(points: DataFrame, model: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """Distances as plain expressions over a small table of each language's centre and inverse scatter."""
        rows = [(lang, [float(x) for x in m], [float(x) for x in inv.ravel()], SpamFinder._ways(m, inv)) for lang, (m, inv) in model.items()]
        table = points.sparkSession.createDataFrame(rows, "lang string, m array<double>, inv array<double>, ways array<double>")
        k = len(FEATURES)
        joined = points.join(F.broadcast(table), "lang")
        diff = [F.col(c) - F.col("m")[i] for i, c in enumerate(FEATURES)]
        d2 = sum(diff[i] * diff[j] * F.col("inv")[i * k + j] for i in range(k) for j in range(k))
        # Half way to a pole a point is as far from it as from the centre.
        toward = F.greatest(*[sum(diff[i] * F.col("ways")[p * k + i] for i in range(k)) for p in range(len(POLES))])
        return joined.select(*points.columns, d2.alias("d2"), toward.alias("toward"))

    @staticmethod
    def _ways(centre: np.ndarray, inverse: np.ndarray) -> list[float]:
        """For each pole the weights that give a point's place between centre (0) and pole (1), along the inverse scatter."""
        out: list[float] = []
        for pole in POLES:
            step = np.array([pole.get(c, m) - m for c, m in zip(FEATURES, centre)])
            along = inverse @ step
            size = float(step @ along)
            out += (along / size if size > 1e-12 else along).tolist()
        return out

    def find(self, docs: DataFrame) -> DataFrame:
        """(doc_id, d2, toward, share) of the flagged documents."""
        scored = self.distances(self.points(docs))
        flagged = scored.where((F.col("d2") > self.quantile) & (F.col("toward") > 0.5))
        return flagged.groupBy("doc_id").agg(F.max("d2").alias("d2"), F.max("toward").alias("toward"), F.max("share").alias("share"))

"""Evaluation texts inside training texts (problem 8).

All n-grams of the items are seeds, in however many items they stand: any of them may be the one that
an edited copy kept. Documents meet items at seeds only. A pair that chained seeds and common words
show to reach neither run nor score is left out, and a Smith-Waterman alignment around the seeds
scores the exact, partial and edited copies that are left. Every run of ``min_run`` common words
contains a seed, so no such copy is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import WordNumbers, grams
from tidemark.session import materialize

_LEAK = "doc_id long, item_id long, score double, run int, first_word int, last_word int"


def align(a: np.ndarray, b: np.ndarray, match: int = 2, miss: int = -1, gap: int = 1) -> tuple[int, int, int]:
    """(best local score, its last place in ``b``, longest common run) of two word sequences."""
    steps = np.arange(len(b) + 1) * gap
    h, run = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64)
    best, end, longest = 0, -1, 0
    for word in a:
        equal = b == word
        cell = np.maximum(h[:-1] + np.where(equal, match, miss), h[1:] - gap)
        row = np.concatenate(([0], np.maximum(cell, 0)))
        h = np.maximum.accumulate(row + steps) - steps  # gaps along b
        run[1:] = np.where(equal, run[:-1] + 1, 0)
        k = int(h.argmax())
        if h[k] > best:
            best, end = int(h[k]), k - 1
        longest = max(longest, int(run.max()))
    return best, end, longest


def most_matches(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by whole rows of bits: no alignment matches more words."""
    masks: dict[int, int] = {}
    for k, word in enumerate(a.tolist()):
        masks[word] = masks.get(word, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        mask = masks.get(word)
        if mask:
            step = row & mask
            row = ((row + step) | (row - step)) & full
    return len(a) - row.bit_count()


def _present(sought: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places in the sorted ``among`` of each of ``sought``, or -1."""
    at = np.searchsorted(among, sought)
    at[at == len(among)] = 0
    return np.where(among[at] == sought, at, -1) if len(among) else np.full(len(sought), -1)


class LeakFinder:
    """Finds items in documents.

    ``block_words``: items are taken in blocks of about so many words (1 M words are some 20 MB on
    each worker), each block against the whole corpus; so what is broadcast has a bound however many
    items there are. Items of equal words are one item inside and are reported under each id.

    Defined results: null or empty texts leak nothing; items of under ``n`` words can't be found, and
    those of under ``min_run`` words only by score; repeated document ids are one; null ids are ignored.
    """

    def __init__(self, n: int = 5, min_run: int = 10, min_score: float = 0.5, block_words: int = 1_000_000):
        if min_run < n:
            raise ValueError("min_run must be n at least")
        self.n, self.min_run, self.min_score, self.block_words = n, min_run, min_score, block_words

    def _blocks(self, items: DataFrame) -> Iterator[list[tuple[list[int], np.ndarray]]]:
        size = items.select(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
        blocks = max(1, -(-size // self.block_words))
        words = WordNumbers()
        for k in range(blocks):
            part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
            same: dict[bytes, tuple[list[int], np.ndarray]] = {}
            for item_id, text in part.collect():  # bounded by block_words
                numbers = words.of(text)
                if len(numbers) >= self.n:
                    same.setdefault(numbers.tobytes(), ([], numbers))[0].append(item_id)
            if same:
                yield [(sorted(set(ids)), numbers) for ids, numbers in same.values()]

    def _seeds(self, block: list[tuple[list[int], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sorted seeds, where the pairs of each begin, and the items and the places of the pairs."""
        own = [grams(numbers, self.n) for _, numbers in block]
        every = np.concatenate(own)
        order = np.argsort(every, kind="stable")
        seeds, starts = np.unique(every[order], return_index=True)
        items = np.repeat(np.arange(len(own), dtype=np.int32), [len(g) for g in own])[order]
        places = np.concatenate([np.arange(len(g), dtype=np.int32) for g in own])[order]
        return seeds, np.append(starts, len(every)), items, places

    def find(self, documents: DataFrame, items: DataFrame) -> DataFrame:
        """(doc_id, item_id, score, run, first_word, last_word): the leaks.

        ``score`` is the alignment's share of the item's full score, ``run`` the longest common run
        of words, the places are those of the document's words that were aligned. A pair is a leak
        when run or score reaches its least value.
        """
        docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
        items = items.select("item_id", "text").where("item_id is not null and text is not null")
        spark, parts = documents.sparkSession, []
        for block in self._blocks(items):
            shared = spark.sparkContext.broadcast((*self._seeds(block), block))
            parts.append(docs.mapInPandas(self._search(shared), _LEAK))
        if not parts:
            return spark.createDataFrame([], _LEAK)
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return materialize(found, "leaks").dropDuplicates(["doc_id", "item_id"])

    def _search(self, shared):
        n, min_run, min_score = self.n, self.min_run, self.min_score

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = WordNumbers()
            index = _Block(shared.value, n)
            for batch in batches:
                out = []
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    numbers = words.of(text)
                    for item, windows, run_too in index.pairs(numbers, min_run, min_score):
                        best, longest = (0, 0, 0), 0
                        ids, wanted = index.block[item]
                        for low, high in windows:
                            if run_too or most_matches(wanted, numbers[low:high]) >= min_score * len(wanted):
                                score, end, common = align(wanted, numbers[low:high])
                                best, longest = max(best, (score, low, low + end)), max(longest, common)
                        score, low, last = best
                        share = score / (2 * len(wanted))
                        if longest >= min_run or share >= min_score:
                            out += [(doc_id, item_id, share, longest, low, last) for item_id in ids]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "run", "first_word", "last_word"])

        return run


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first[k]`` to ``first[k] + size[k] - 1`` of every k, one range after another."""
    ends = size.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class _Block:
    """The seeds and words of a block of items, laid out for whole-array look-ups."""

    def __init__(self, shared: tuple, n: int):
        self.n = n
        self.seeds, self.starts, self.items, self.places, self.block = shared
        # A table of seeds' leading bits, a sixteenth full at most, spares most look-ups.
        self.shift = np.uint64(64 - min(24, max(12, int(len(self.seeds) * 16).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.seeds >> self.shift] = True
        self.sizes = np.array([len(numbers) for _, numbers in self.block])
        own = [np.unique(numbers, return_counts=True) for _, numbers in self.block]
        self.distinct = np.array([len(words) for words, _ in own])
        self.first = self.distinct.cumsum() - self.distinct
        self.times = np.concatenate([times for _, times in own])
        self.vocabulary, self.words = np.unique(np.concatenate([words for words, _ in own]), return_inverse=True)
        self.there = np.zeros(len(self.vocabulary), np.int64)

    def common(self, numbers: np.ndarray, item: np.ndarray) -> np.ndarray:
        """For each of the items, how many of its words ``numbers`` holds, each as often as both have it at most."""
        known = _present(numbers, self.vocabulary)
        known, times = np.unique(known[known >= 0], return_counts=True)
        self.there[known] = times
        size = self.distinct[item]
        entry = _ranges(self.first[item], size)
        out = np.add.reduceat(np.minimum(self.there[self.words[entry]], self.times[entry]), size.cumsum() - size)
        self.there[known] = 0
        return out

    def pairs(self, numbers: np.ndarray, min_run: int, min_score: float) -> Iterator[tuple[int, list[tuple[int, int]], bool]]:
        """(item, windows of the document, whether a run may be there) of the items that the words can reach.

        A run is a chain of seeds one after another, and a score has two for each common word at most;
        items that can reach neither are left out, all of them at once, before any window is looked at.
        """
        found = grams(numbers, self.n)
        at = np.flatnonzero(self.maybe[found >> self.shift])
        seed = _present(found[at], self.seeds)
        at, seed = at[seed >= 0], seed[seed >= 0]
        if not len(at):
            return
        many = self.starts[seed + 1] - self.starts[seed]
        pair = _ranges(self.starts[seed], many)
        item, offset = self.items[pair], np.repeat(at, many) - self.places[pair]
        place = np.repeat(at, many)
        order = np.lexsort((place, offset, item))
        item, offset, place = item[order], offset[order], place[order]
        item, first = np.unique(item, return_index=True)
        edge = np.append(first, len(offset))
        new = np.ones(len(offset), bool)
        new[1:] = (offset[1:] != offset[:-1]) | (place[1:] != place[:-1] + 1)
        new[first] = True
        chain = np.diff(np.append(np.flatnonzero(new), len(offset)))
        run_too = np.maximum.reduceat(chain, (new.cumsum() - 1)[first]) >= min_run - self.n + 1
        size, common = self.sizes[item], self.common(numbers, item)
        for k in np.flatnonzero(run_too | (common >= min_score * size)).tolist():
            windows: list[tuple[int, int]] = []
            for low in (np.unique(offset[edge[k] : edge[k + 1]]) - size[k] // 2).tolist():
                low, high = max(0, low), low + 2 * int(size[k])
                if windows and low <= windows[-1][1]:
                    windows[-1] = (windows[-1][0], max(high, windows[-1][1]))
                else:
                    windows.append((low, high))
            yield int(item[k]), windows, bool(run_too[k])

"""The search engine: text, semantic and hybrid modes over index tables and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed, text, urls
from tidemark.operators import index as ix
from tidemark.operators import search as se
from tidemark.session import materialize


class SearchEngine:
    """Searches ``postings``, ``lengths``, ``store`` (doc_id, url, title, preview) and ``vectors`` (doc_id, embedding).

    Pools have a size that follows the limit asked for, not the data: they are what is joined and ranked
    at the end. Without vectors or a query vector a hybrid search is a text search.
    """

    def __init__(self, postings: DataFrame, lengths: DataFrame, store: DataFrame, vectors: DataFrame | None = None,
                 stemmer: str = "none", centres: np.ndarray | None = None, probes: int = 16):
        self.postings, self.lengths, self.store, self.vectors = postings, lengths, store, vectors
        self.stemmer, self.centres, self.probes = stemmer, centres, probes
        self.stats = ix.corpus_stats(lengths)

    @classmethod
    def over(cls, docs: DataFrame, vectors: DataFrame | None = None, stemmer: str = "none") -> SearchEngine:
        """An engine over documents (doc_id, url, title, body, headings, meta_description), indexed once."""
        posts = materialize(ix.postings(docs, fixed.FIELD_WEIGHTS, stemmer=stemmer), "postings")
        store = docs.select("doc_id", "url", "title", text.preview(F.col("body")).alias("preview"))
        return cls(posts, materialize(ix.lengths(posts), "lengths"), materialize(store, "store"), vectors, stemmer)

    @classmethod
    def open(cls, index: ix.Index, vectors: DataFrame | None = None) -> SearchEngine:
        """Over what an index on disk has published by now: one version, whatever is appended later.

        Vectors of the index are searched by cells; ``vectors`` given here are searched exactly.
        """
        version, centres = index.store.attempt(), None
        if vectors is None and (vectors := version.read("vectors")) is not None:
            centres = se.centre_matrix(version.read("centres"))
        return cls(version.read("postings"), version.read("lengths"), version.read("docstore"), vectors, index.stemmer, centres)

    def _text(self, query: str, limit: int, pool: int, drop_errors: bool) -> DataFrame:
        found = se.bm25_search(self.postings, self.lengths, self.stats, self.store, query, pool, stemmer=self.stemmer)
        found = found.where(~urls.is_junk(F.col("url"), F.col("title")))
        if drop_errors:
            found = found.where(~urls.is_error(F.col("title")))
        return se.top_k(found, limit)

    def _near(self, vector: list[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
        if self.centres is not None and allowed is None:
            return se.nearest_cells(self.vectors, self.centres, vector, k, self.probes)
        return se.nearest(self.vectors, vector, k, key="doc_id", allowed=allowed)

    def search(self, query: str, mode: str = "hybrid", limit: int = 10, offset: int = 0, query_vector: list[float] | None = None) -> DataFrame:
        """(doc_id, url, title, score), best first; a limit of 0 is 10, an unknown mode is hybrid."""
        limit = (limit or 10) + offset
        if mode not in ("text", "semantic"):
            mode = "hybrid"
        if self.vectors is None or query_vector is None:
            mode = "text"
        if mode == "text":
            out = self._text(query, limit, 3 * limit, True)
        elif mode == "semantic":
            out = se.top_k(self._near(query_vector, limit).join(self.store.select("doc_id", "url", "title"), "doc_id"), limit)
        else:
            out = self._hybrid(query, limit, query_vector)
        ordered = out.select("doc_id", "url", "title", "score").orderBy(F.col("score").desc(), "doc_id")
        return ordered.offset(offset).limit(limit - offset) if offset else ordered

    def _hybrid(self, query: str, limit: int, vector: list[float]) -> DataFrame:
        pool = se.pool_size(limit)
        hits = materialize(self._text(query, pool, 2 * pool, False), "hits")
        titles = self.store.select("doc_id", "url", "title")
        candidates = F.broadcast(hits.select("doc_id"))  # at most the pool's size
        if hits.isEmpty():
            near = self._near(vector, limit)
        else:
            near = self._near(vector, pool, candidates)
            if len(query.split()) <= 2:
                # Hits the text search lacks come after those it has.
                extra = self._near(vector, max(1, pool // 8)).join(candidates, "doc_id", "left_anti").withColumn("score", F.col("score") - 10)
                near = near.unionByName(extra)
        return se.hybrid(hits, near.join(titles, "doc_id"), query, limit)

    def suggest(self, prefix: str, limit: int = 5) -> DataFrame:
        """(doc_id, url, title, score) for what is typed so far: nothing under two bytes, at most ten."""
        limit = min(limit or 5, 10)
        found = se.bm25_search(self.postings, self.lengths, self.stats, self.store, prefix, limit, stemmer=self.stemmer)
        return found if len(prefix.encode()) >= 2 else found.limit(0)

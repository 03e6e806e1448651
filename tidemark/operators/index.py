"""Inverted index as tables: postings, lengths of documents, figures of the corpus, document store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed, text
from tidemark.operators import search
from tidemark.operators.store import DeltaStore
from tidemark.session import materialize


def first_versions(docs: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key (a known document isn't indexed again), without a window over large groups."""
    columns = [c for c in docs.columns if c != key]
    return docs.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("__row")).select(key, "__row.*")


def stem_terms(terms: DataFrame) -> DataFrame:
    """``terms`` with the column ``term`` stemmed; each distinct word is stemmed once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from functools import lru_cache

        from tidemark.functions.stem import stem

        known = lru_cache(200_000)(stem)
        for batch in batches:
            yield batch.assign(term=batch["term"].map(known))

    return terms.mapInPandas(run, terms.schema)


def postings(docs: DataFrame, fields: dict[str, int] | None = None, key: str = "doc_id", stemmer: str = "none") -> DataFrame:
    """(key, term, tf): weighted term frequencies over the fields (text or array of texts).

    ``stemmer`` is ``none``, ``legacy`` (suffixes) or ``snowball``. Null fields have no tokens. Tokens are
    trimmed and chosen after they are spread, inside generated code.
    """
    fields = fields or {"body": 1}
    types = dict(docs.dtypes)
    values = [F.struct((F.array_join(F.col(name), " ") if types[name].startswith("array") else F.col(name)).alias("text"), F.lit(weight).cast("long").alias("w"))
              for name, weight in fields.items()]
    each = docs.select(key, F.explode(F.array(*values)).alias("f")) if len(values) > 1 else docs.select(key, values[0].alias("f"))
    spread = each.select(key, F.col("f.w").alias("w"), F.explode(text.raw_tokens(F.col("f.text"))).alias("raw"))
    spread = spread.select(key, "w", text.token(F.col("raw")).alias("term")).where(text.is_term(F.col("term")))
    if stemmer == "legacy":
        spread = spread.withColumn("term", text.legacy_stem(F.col("term")))
    counted = spread.groupBy(key, "term").agg(F.sum("w").alias("tf"))
    if stemmer == "snowball":
        counted = stem_terms(counted).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return counted


def unknown(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` whose key isn't among ``known``."""
    return docs.join(known.select(key), key, "left_anti")


def posting_lists(posts: DataFrame, block: int = 65_536, key: str = "doc_id") -> DataFrame:
    """(term, block, keys): sorted lists of the keys that hold each term, cut into blocks of ``block`` keys so that no list grows with the data."""
    return posts.groupBy("term", F.floor(F.col(key) / block).cast("long").alias("block")).agg(F.sort_array(F.collect_list(key)).alias("doc_ids"))


def lengths(posts: DataFrame, key: str = "doc_id") -> DataFrame:
    return posts.groupBy(key).agg(F.sum("tf").alias("doc_len"))


def doc_freq(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(doc_lengths: DataFrame) -> DataFrame:
    """One row: number of documents, total and average length (0 if there are none)."""
    return doc_lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"),
                           F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len"))


class Index:
    """An index on disk: versions under ``path``, each an append of documents not known before.

    Postings, lengths, document store and vectors are delta tables of one ``DeltaStore``: a version is
    published by one manifest, so readers see whole versions only and an append that died is run again.
    """

    def __init__(self, spark: SparkSession, path: str, stemmer: str = "none"):
        self.spark, self.store, self.stemmer = spark, DeltaStore(spark, path), stemmer

    def table(self, name: str) -> DataFrame:
        found = self.store.read(name)
        if found is None:
            raise ValueError(f"the index has no {name} yet")
        return found

    def versions(self) -> int:
        return self.store.manifest()["number"]

    def add(self, docs: DataFrame) -> int:
        """Index documents (doc_id, url, title, body, headings, meta_description); returns the new version.

        Rejected and already known documents are left out; of a repeated id the row with the smallest
        address and text counts. Postings are range-partitioned and sorted by term and id: a search reads few row
        groups, and a term in a third of all documents lies in several files.
        """
        attempt = self.store.attempt()
        docs = docs.select("doc_id", "url", "title", "body", "headings", "meta_description").where("doc_id is not null")
        docs = first_versions(docs.withColumn("__order", F.struct("url", "title", "body")), "doc_id", "__order").drop("__order").where(text.admitted(F.col("title"), F.col("body")))
        known = attempt.read("docstore")
        if known is not None:
            docs = unknown(docs, known)
        docs = materialize(docs, "arrivals")
        posts = postings(docs, fixed.FIELD_WEIGHTS, stemmer=self.stemmer)
        posts = attempt.write(posts.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), "postings")
        attempt.write(lengths(posts), "lengths")
        attempt.write(docs.select("doc_id", "url", "title", text.preview(F.col("body")).alias("preview")), "docstore")
        attempt.publish()
        return attempt.number

    def add_vectors(self, vectors: DataFrame, cells: int = 64, sample: int = 10_000) -> int:
        """Append vectors (doc_id, embedding) of unit length to their cells; an id that is there keeps its vector.

        The first append fits the cells' centres on a bounded sample; every vector is put into its nearest.
        """
        attempt = self.store.attempt()
        vectors = vectors.select("doc_id", "embedding").where("doc_id is not null and embedding is not null")
        centres, known = attempt.read("centres"), attempt.read("vectors")
        if centres is None:
            fitted = search.fit_cells(vectors, cells, sample)
            centres = attempt.write(self.spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(fitted)], "cell int, centre array<double>"), "centres")
        if known is not None:
            vectors = unknown(vectors, known)
        placed = search.assign_cells(vectors, search.centre_matrix(centres))
        single = placed.groupBy("doc_id").agg(F.min(F.struct("embedding", "cell")).alias("v")).select("doc_id", "v.*")
        attempt.write(single.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id"), "vectors")
        attempt.publish()
        return attempt.number

    def compact(self) -> None:
        """Join the deltas of each table into one."""
        for name in ("postings", "lengths", "docstore", "vectors"):
            self.store.compact(name)

    def stats(self) -> DataFrame:
        return corpus_stats(self.table("lengths"))


def index_stats(posts: DataFrame) -> DataFrame:
    """One row: documents, postings and distinct terms."""
    return posts.agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))

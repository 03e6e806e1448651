"""Searching: BM25, nearest vectors, fusion of rankings, and what shapes the final list."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import fixed, text, urls
from tidemark.functions.stem import stem, stem_legacy


def query_tokens(query: str) -> list[str]:
    """A query's tokens before stemming, in order; repeated words stay, for each of them scores."""
    low, high = fixed.TOKEN_BYTES
    found = [t.strip("'") for t in re.findall(r"[^\W_']+(?:'+[^\W_']+)*|'", query.lower())]
    return [t for t in found if low <= len(t.encode()) <= high and t not in fixed.STOP_WORDS]


def query_terms(query: str, stemmer: str = "none") -> list[str]:
    """The terms a query asks an index for: each word's stem, and its legacy stem where that differs."""
    words = query_tokens(query)
    if stemmer == "none":
        return words
    out = []
    for word in words:
        legacy = stem_legacy(word)
        if stemmer == "legacy":
            out.append(legacy)
        else:
            own = stem(word)
            out += [own] if own == legacy else [own, legacy]
    return out


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def term_score(tf: Column, df: Column, doc_len: Column, n_docs: Column, avg_len: Column) -> Column:
    k1, b = fixed.BM25_K1, fixed.BM25_B
    return idf(n_docs, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))


def bm25_scores(posts: DataFrame, doc_lengths: DataFrame, stats: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """(key, score) of the documents that hold any of ``terms``; a term given n times scores n times.

    Only the postings of the terms are read (the filter reaches the scan), so everything after it is
    as large as their posting lists; the statistics are one row.
    """
    wanted: dict[str, int] = {}
    for term in terms:
        wanted[term] = wanted.get(term, 0) + 1
    hits = posts.where(F.col("term").isin(list(wanted)) if wanted else F.lit(False))
    times = F.element_at(F.create_map(*[x for t, n in wanted.items() for x in (F.lit(t), F.lit(n))]), F.col("term")) if wanted else F.lit(0)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = (hits.join(F.broadcast(df), "term")  # a row for each of the query's terms
              .join(doc_lengths, key, "left").crossJoin(F.broadcast(stats))  # one row
              .withColumn("s", times * term_score(F.col("tf"), F.col("df"), F.coalesce("doc_len", F.lit(1)), F.col("n_docs"), F.col("avg_len"))))
    return scored.groupBy(key).agg(F.sum("s").alias("score"))


def top_k(scored: DataFrame, k: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows; equal scores follow the smaller key."""
    return scored.orderBy(F.col(score).desc(), key).limit(k)


def bm25_search(posts: DataFrame, doc_lengths: DataFrame, stats: DataFrame, store: DataFrame, query: str, k: int, key: str = "doc_id", stemmer: str = "none") -> DataFrame:
    """(key, title, url, score): the 4k best by BM25 over the stems, then the k best with the title bonus for the words as typed."""
    tokens = query_tokens(query)
    pool = top_k(bm25_scores(posts, doc_lengths, stats, query_terms(query, stemmer), key), 4 * k, key)
    full = store.join(F.broadcast(pool), key)  # 4k rows
    return top_k(full.withColumn("score", F.col("score") + text.title_bonus(F.col("title"), tokens, query, F.col("score"))).select(key, "title", "url", "score"), k, key)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit length; vectors of almost no length stay as they are."""
    size = l2_norm(v)
    return F.when(size > 1e-8, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """(key, score): exact k nearest by dot product to one query vector; ``allowed`` keys only, if given."""
    if allowed is not None:
        vectors = vectors.join(allowed, key, "left_semi")
    target = F.array(*[F.lit(float(x)) for x in query])
    return top_k(vectors.where(F.size(vector) == len(query)).select(key, dot(F.col(vector), target).alias("score")), k, key)


def _block_search(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, targets = shared.value
        scores, keys = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
        for batch in batches:
            if len(batch):
                own = targets @ np.stack(batch["v"].to_numpy()).astype(np.float64).T
                scores = np.concatenate([scores, own], axis=1)
                keys = np.concatenate([keys, np.broadcast_to(batch["k"].to_numpy(), own.shape)], axis=1)
                order = np.lexsort((keys, -scores), axis=1)[:, :k]
                scores, keys = np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)
        yield pd.DataFrame({"q": np.repeat(ids, scores.shape[1]), "k": keys.ravel(), "score": scores.ravel()})

    return run


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048, key: str = "vec_id", vector: str = "embedding", query: str = "query_id") -> DataFrame:
    """(query, key, score): k nearest for each of a stated set of query vectors of one length.

    The set is cut by hash into blocks of about ``block`` queries; a block at a time reaches the
    driver and is broadcast, and each partition of the vectors keeps k rows a query before the shuffle.
    """
    spark, out = vectors.sparkSession, None
    asked = queries.where(F.col(query).isNotNull() & F.col(vector).isNotNull())
    blocks = max(1, -(-asked.count() // block))
    for at in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == at).select(query, vector).collect()
        if not part:
            continue
        size = len(part[0][1])
        shared = spark.sparkContext.broadcast(([r[0] for r in part], np.array([r[1] for r in part], np.float64)))
        rows = vectors.where(F.size(vector) == size).select(F.col(key).alias("k"), F.col(vector).alias("v"))
        near = rows.mapInPandas(_block_search(shared, k), "q long, k long, score double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], f"{query} long, {key} long, score double")
    place = Window.partitionBy("q").orderBy(F.col("score").desc(), "k")
    return out.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k).select(F.col("q").alias(query), F.col("k").alias(key), "score")


def ranked(list_no: int, rows: DataFrame, key: str = "doc_id", score: str = "score") -> DataFrame:
    """One list for fusion: (list_no, place, key, url, title); places from 1."""
    order = Window.orderBy(F.col(score).desc(), key)  # a list of at most the pool's size
    return rows.withColumn("place", F.row_number().over(order)).withColumn("list_no", F.lit(list_no)).select("list_no", "place", key, "url", "title")


def rrf(lists: DataFrame, keys: list[str], multi_source: float = 0.0) -> DataFrame:
    """(keys, score, sources, url, title) of lists (list_no, place, ...): reciprocal-rank sums; the first list's texts win."""
    summed = lists.groupBy(*keys).agg(
        F.sum(1.0 / (fixed.RRF_K + F.col("place"))).alias("score"), F.count("*").alias("sources"),
        F.min_by("url", "list_no").alias("url"), F.min_by("title", "list_no").alias("title"))
    return summed.withColumn("score", F.col("score") + F.when(F.col("sources") > 1, multi_source).otherwise(0.0))


def _longer_with(prefix: str):
    return lambda word: word.startswith(prefix) & (F.octet_length(word) > len(prefix.encode()))


def url_boost(url: Column, title: Column, query: str) -> Column:
    """What address and title add for ``query``: penalties, the ladder of domain matches, depth, title."""
    low = query.lower().strip()
    solid, terms, w = "".join(low.split()), low.split(), fixed.BOOST
    name, bare, where = urls.domain_name(url), urls.bare_host(url), urls.path(url)
    title = F.coalesce(title, F.lit(""))
    title_low = F.lower(title)
    home = where.isin(fixed.HOME_PATHS)
    nav = F.when(home, w["nav_homepage"]).otherwise(0.0) if len(terms) <= 2 else F.lit(0.0)
    size, name_size = len(low.encode()), F.octet_length(name)
    if len(terms) == 1:
        rest = F.when(name.startswith(low) & F.lit(size >= 3), F.lit(w["domain_prefix"] * size) / name_size).when(
            F.lit(low).startswith(name) & (name_size >= 3), 0.5 * w["domain_prefix"] * name_size / size).otherwise(0.0)
    else:
        rest = F.lit(0.0)
        for term in reversed(terms):
            exact = 0.4 * w["domain_exact"] + F.when(urls.is_brand(name, bare), 0.5 * w["brand"]).otherwise(0.0)
            step = F.when(name == term, exact)
            if len(term.encode()) >= 3:
                step = step.when(name.startswith(term), 0.3 * w["domain_prefix"])
            rest = step.otherwise(rest)
    domain = (F.when(name.isin(solid, low), w["domain_exact"] + F.when(urls.is_preferred(bare), w["tld"]).otherwise(0.0)
                     + F.when(urls.is_brand(name, bare), w["brand"]).otherwise(0.0) + nav)
              .when(bare.isin(solid, low), w["domain_exact"] + nav).otherwise(rest))
    depth = F.length(where) - F.length(F.replace(where, F.lit("/"), F.lit("")))
    place = F.when(home, w["homepage"]).when(depth <= 2, w["shallow"]).when(depth >= 5, w["deep"]).otherwise(0.0)
    plain = F.regexp_replace(title_low, r"[^\p{L}\p{N}\s]", "")
    named = F.when(title_low.contains(low), 0.5 * w["title"]).when(plain.contains(solid), 0.4 * w["title"]).otherwise(0.0)
    if len(terms) == 1:
        named = F.when(title_low.startswith(low), w["title"]).otherwise(named)
    longer = F.lit(0.0)
    title_words = F.split(title_low, r"[^\p{L}\p{N}]")
    for term in terms:
        n = len(term.encode())
        if n >= 3:
            first = F.get(F.filter(title_words, _longer_with(term)), F.lit(0))
            longer = longer + F.coalesce(F.lit(w["title_prefix"] * n) / F.octet_length(first), F.lit(0.0))
    total = (F.when(urls.is_junk(url, title), w["junk"]).otherwise(0.0) + F.when(urls.is_error(title), w["error"]).otherwise(0.0)
             + F.when(urls.is_profile(url), w["profile"]).otherwise(0.0) + domain + place + named + longer)
    return F.when(urls.host(url).isNull(), 0.0).otherwise(total)


def freshness(fused: DataFrame, key: str = "doc_id", group: list[str] | None = None) -> DataFrame:
    """Adds a little by the key's share of the largest key in its list (``group``), the key taken as unsigned.

    Kept for equal results: keys are hashes, so it tells nothing of age. Added in single precision.
    """
    group = group or []
    unsigned = F.when(F.col(key) < 0, F.col(key).cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.col(key).cast("decimal(20,0)"))
    top = fused.groupBy(*group).agg(F.max(unsigned).alias("__top"))
    add = (F.lit(fixed.BOOST["freshness"]) * unsigned.cast("double") / F.col("__top").cast("double")).cast("float")
    beside = fused.join(top, group) if group else fused.crossJoin(F.broadcast(top))  # one row
    return beside.withColumn("score", (F.col("score").cast("float") + F.when(F.col("__top") > 0, add).otherwise(F.lit(0.0).cast("float"))).cast("float")).drop("__top")


def dedup_by_url(rows: DataFrame, key: str = "doc_id", group: list[str] | None = None) -> DataFrame:
    """The best row of each address key in each list (``group``); equal scores: the smaller key."""
    columns = rows.columns
    best = rows.groupBy(*(group or []), urls.url_key(F.col("url")).alias("__key")).agg(
        F.max_by(F.struct(*columns), F.struct("score", (-F.col(key)).alias("less"))).alias("__row"))
    return best.select("__row.*")


def cap_domains(rows: DataFrame, query: str, key: str = "doc_id", usual: int = 3, navigation: int = 10, group: list[str] | None = None) -> DataFrame:
    """At most three rows of a registered domain, ten while rows match the query's name, in order of score.

    A row is taken as long as its domain has given fewer rows than the row's own limit. In closed
    form: the first three of a domain, and of the later rows the first seven that match the name.
    """
    low = query.lower().strip()
    solid = "".join(low.split())
    name = F.coalesce(urls.domain_name(F.col("url")), F.lit(""))
    match = (name != "") & (name.isin(solid, low) | (F.lit(len(low.encode()) >= 4) & name.startswith(low)))
    root = F.coalesce(urls.root_domain(F.lower(urls.host(F.col("url")))), F.lit(""))
    order = Window.partitionBy(*(group or []), "__root").orderBy(F.col("score").desc(), key)
    numbered = rows.withColumn("__root", root).withColumn("__nav", match).withColumn("__n", F.row_number().over(order))
    later = F.sum((F.col("__nav") & (F.col("__n") > usual)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("__later", later).where((F.col("__n") <= usual) | (F.col("__nav") & (F.col("__later") <= navigation - usual))).select(*rows.columns)


def hybrid(text_hits: DataFrame, near_hits: DataFrame, query: str, k: int, key: str = "doc_id") -> DataFrame:
    """(key, url, title, score): text and vector rankings fused, boosted, deduplicated, capped, cut.

    Both inputs are pools of bounded size, (key, url, title, score).
    """
    both = ranked(0, text_hits, key).unionByName(ranked(1, near_hits, key))
    fused = rrf(both, [key], fixed.BOOST["multi_source"])
    boosted = fused.withColumn("score", F.col("score") + url_boost(F.col("url"), F.col("title"), query)).select(key, "url", "title", "score")
    return top_k(cap_domains(dedup_by_url(freshness(boosted, key), key), query, key), k, key)


def pool_size(limit: int) -> int:
    return max(200, 4 * limit)


def min_max(rows: DataFrame, group: list[str] | None = None, score: str = "score") -> DataFrame:
    """``rows`` with ``score`` scaled to 0..1 within each list (``group``); a list without spread gets ones."""
    group = group or []
    ends = rows.groupBy(*group).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    beside = rows.join(ends, group) if group else rows.crossJoin(F.broadcast(ends))  # one row
    span = F.col("__hi") - F.col("__lo")
    return beside.withColumn(score, F.when(span < 1.2e-7, 1.0).otherwise((F.col(score) - F.col("__lo")) / span)).drop("__lo", "__hi")


def weighted_fusion(text_hits: DataFrame, near_hits: DataFrame, alpha: float, key: str = "doc_id", group: list[str] | None = None) -> DataFrame:
    """(group, key, score): alpha times the min-max scaled text score plus the rest times the cosine moved to 0..1."""
    alpha, keys = min(1.0, max(0.0, alpha)), [*(group or []), key]
    scaled = min_max(text_hits.select(*keys, "score"), group).withColumnRenamed("score", "t")
    moved = near_hits.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 1) / 2)).alias("v"))
    return scaled.join(moved, keys, "full").select(*keys, (alpha * F.coalesce("t", F.lit(0.0)) + (1 - alpha) * F.coalesce("v", F.lit(0.0))).alias("score"))


def mean_pooled(tokens: Column, mask: Column, dims: int) -> Column:
    """The mean of the token vectors whose mask is set, at unit length, cut or padded with zeros to ``dims``.

    ``tokens`` is an array of vectors, ``mask`` one number for each; a mask that is all zero gives zeros.
    """
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double")), F.lit(1e-9))
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    weighted = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * F.coalesce(m, F.lit(0)).cast("double")))
    summed = F.aggregate(weighted, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    unit = normalized(F.transform(summed, lambda x: x / weight))
    return F.slice(F.concat(unit, F.array_repeat(F.lit(0.0), dims)), 1, dims)


def hash_embedding(text_column: Column, dims: int = 384) -> Column:
    """A unit vector that depends on the text only: what stands in for an encoder that isn't there."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: F.xxhash64(text_column, i) / F.lit(2.0**63))
    return normalized(raw)


def fit_cells(vectors: DataFrame, cells: int, sample: int = 10_000, vector: str = "embedding", rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of at most ``cells`` cells, fitted on a sample of at most ``sample`` vectors; all vectors are indexed by them."""
    rows = vectors.where(F.col(vector).isNotNull()).select(vector).limit(sample).collect()  # bounded by ``sample``
    sizes = [len(r[0]) for r in rows]
    if not sizes:
        return np.empty((0, 0))
    points = np.array([r[0] for r in rows if len(r[0]) == max(set(sizes), key=sizes.count)], np.float64)
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (own == k).any():
                mean = points[own == k].mean(axis=0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def centre_matrix(centres: DataFrame) -> np.ndarray:
    """Centres (cell, centre) as a matrix: as many rows as there are cells."""
    return np.array([r["centre"] for r in centres.orderBy("cell").collect()], np.float64)


def assign_cells(vectors: DataFrame, centres: np.ndarray, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(key, vector, cell): each vector in the cell of the most similar centre; those of another length are left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # cells x numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=(np.stack(batch[vector].to_numpy()).astype(np.float64) @ shared.value.T).argmax(axis=1).astype(np.int32))

    rows = vectors.select(key, vector).where(F.size(vector) == (centres.shape[1] if centres.size else -1))
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"{key} {kinds[key]}, {vector} {kinds[vector]}, cell int")


def nearest_cells(placed: DataFrame, centres: np.ndarray, query: list[float], k: int, probes: int = 16, key: str = "doc_id", vector: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """(key, score): about the k nearest, exactly compared within the ``probes`` cells nearest to the query; only these are read."""
    order = np.argsort(-(centres @ np.asarray(query, np.float64)), kind="stable")[:probes] if centres.size else []
    return nearest(placed.where(F.col("cell").isin([int(c) for c in order])), query, k, key, vector, allowed)


def nearest_cells_batch(placed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 16, key: str = "vec_id", vector: str = "embedding", query: str = "query_id") -> DataFrame:
    """(query, key, score): about the k nearest for each query vector: it meets the vectors of its ``probes`` nearest cells only."""
    shared = placed.sparkSession.sparkContext.broadcast(centres)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cells = np.argsort(-(np.stack(batch["qv"].to_numpy()).astype(np.float64) @ shared.value.T), axis=1, kind="stable")[:, :probes]
                yield batch.assign(cells=list(cells.astype(np.int32)))

    asked = queries.where(F.size(vector) == (centres.shape[1] if centres.size else -1)).select(query, F.col(vector).cast("array<double>").alias("qv"))
    asked = asked.mapInPandas(probe, f"{query} long, qv array<double>, cells array<int>").select(query, "qv", F.explode("cells").alias("cell"))
    scored = asked.join(placed, "cell").select(query, key, dot(F.col(vector), F.col("qv")).alias("score"))
    place = Window.partitionBy(query).orderBy(F.col("score").desc(), key)
    return scored.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k).drop("n")


def nearest_lsh(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", tables: int = 8, width: float = 0.5) -> DataFrame:
    """(key, score): about the k nearest, by random projections; for unit vectors, whose distance orders like the dot product."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.where(F.size(vector) == len(query)).select(key, F.col(vector).alias("v"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=7).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(query), k)
    return near.select(key, dot(F.col("v"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))

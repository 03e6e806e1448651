"""The k most similar vectors for every vector (problem 3), by vantage-point trees.

A tree over a bounded sample cuts the unit sphere into shards; each shard builds a vantage-point
tree of its own. Distances are angles, a metric. A vector is first searched in its home shard, which
bounds the distance of its k-th neighbour; then it is sent to those other shards only that the
triangle inequality leaves within ``factor`` times that distance. Factor one is exact, near copies and
ties included, for everything is in double precision and bounds have a slack over its rounding; smaller
factors prune more and may lose neighbours. Vectors are sent in rounds, some shards at a time, and each
table of vectors goes when the next is written: disk holds a few copies of the vectors, however often
they are sent.

A vantage point need not be a stored vector. Taken from stored vectors, all distances are about a
right angle in high dimensions and nothing can be pruned; so the point is the direction along which
the node's vectors spread most, found by power iteration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize, release

LEAF = 256
#: Similarities that differ by less are equal: rounding of double-precision products.
DIGITS = 12


def _angles(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ vantage, -1, 1))


def _vantage(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Direction of the largest spread around the mean, of at most 2,000 of the node's vectors."""
    some = points if len(points) <= 2000 else points[rng.choice(len(points), 2000, replace=False)]
    some = some - some.mean(axis=0)
    v = rng.standard_normal(points.shape[1])
    for _ in range(8):
        v = some.T @ (some @ v)
        size = np.linalg.norm(v)
        if size < 1e-12:
            return np.eye(1, points.shape[1])[0]
        v = v / size
    return v


def build(points: np.ndarray, leaf: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of a tree: (vantage, low and high angle of the left child, of the right child, left, right),
    or (rows,) for a leaf. Node 0 is the root."""
    nodes: list[tuple] = [()]
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        if len(rows) <= leaf:
            nodes[at] = (rows,)
            continue
        vantage = _vantage(points[rows], rng)
        angle = _angles(points[rows], vantage)
        order = np.argsort(angle, kind="stable")
        half = len(rows) // 2
        left, right = rows[order[:half]], rows[order[half:]]
        a = angle[order]
        nodes[at] = (vantage, a[0], a[half - 1], a[half], a[-1], len(nodes), len(nodes) + 1)
        stack += [(len(nodes), left), (len(nodes) + 1, right)]
        nodes += [(), ()]
    return nodes


class _Search:
    """Searches one shard's tree for many vectors at once."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int, factor: float, rng: np.random.Generator):
        self.points, self.ids, self.k, self.factor = points, ids, k, factor
        self.nodes = build(points, LEAF, rng)

    def run(self, queries: np.ndarray, own: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines), ``k`` each: the best of the shard without ``own``. ``reach``: angle beyond which nothing counts."""
        self.q, self.own, self.reach = queries, own, reach.astype(np.float64)
        self.best = np.full((len(queries), self.k), -1, np.int64)
        self.cos = np.full((len(queries), self.k), -2.0)
        if len(queries) and len(self.points):
            self._visit(0, np.arange(len(queries)))
        return self.best, self.cos

    def _visit(self, at: int, who: np.ndarray) -> None:
        node = self.nodes[at]
        if len(node) == 1:
            for part in np.array_split(who, -(-len(who) // 4096)):
                self._leaf(node[0], part)
            return
        vantage, lo1, hi1, lo2, hi2, left, right = node
        angle = _angles(self.q[who], vantage)
        near_left = angle <= (hi1 + lo2) / 2
        gap_left = np.maximum(0, np.maximum(angle - hi1, lo1 - angle))
        gap_right = np.maximum(0, np.maximum(lo2 - angle, angle - hi2))
        for first, second, side, gap in ((left, right, near_left, gap_right), (right, left, ~near_left, gap_left)):
            mine, gap = who[side], gap[side]
            if len(mine):
                self._visit(first, mine)
                keep = gap <= self.reach[mine] * self.factor + 1e-6
                if keep.any():
                    self._visit(second, mine[keep])

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        cos = np.round(self.q[who] @ self.points[rows].T, DIGITS)
        cos[self.own[who][:, None] == self.ids[rows][None, :]] = -2
        both = np.concatenate([self.cos[who], cos], axis=1)
        at = np.concatenate([self.best[who], np.broadcast_to(rows, (len(who), len(rows)))], axis=1)
        some = min(3 * self.k, both.shape[1] - 1)
        top = np.argpartition(-both, some, axis=1)[:, : some + 1]
        found, places = np.take_along_axis(both, top, axis=1), np.take_along_axis(at, top, axis=1)
        order = self._order(found, places)
        cos_k, best_k = np.take_along_axis(found, order, axis=1), np.take_along_axis(places, order, axis=1)
        # Where the last of the few is as similar as the k-th, more are: all are put in order.
        tied = np.flatnonzero((found.min(axis=1) >= cos_k[:, -1]) & (cos_k[:, -1] > -2))
        if len(tied):
            order = self._order(both[tied], at[tied])
            cos_k[tied], best_k[tied] = np.take_along_axis(both[tied], order, axis=1), np.take_along_axis(at[tied], order, axis=1)
        self.cos[who], self.best[who] = cos_k, best_k
        worst = cos_k[:, -1]
        self.reach[who] = np.minimum(self.reach[who], np.where(worst > -2, np.arccos(np.clip(worst, -1, 1)), np.inf))

    def _order(self, cos: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places of the ``k`` most similar of each row, equal ones by id."""
        return np.lexsort((self.ids[rows], -cos), axis=1)[:, : self.k]


def _unpack(vectors, dims: int) -> np.ndarray:
    """Unit vectors in double precision; ``vectors`` are bytes of the stored ones."""
    every = b"".join(vectors)
    if not every:
        return np.empty((0, dims))
    kind = np.float32 if len(every) == 4 * dims * len(vectors) else np.float64
    points = np.frombuffer(every, kind).reshape(-1, dims).astype(np.float64)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _rounds(asks: list[tuple[int, int]], room: float) -> list[tuple[int, int]]:
    """First and last shard of each round: shards in order while what they are sent has room, one at least."""
    out: list[tuple[int, int]] = []
    left = 0.0
    for shard, n in asks:
        if out and n <= left:
            out[-1] = (out[-1][0], shard)
        else:
            out.append((shard, shard))
            left = room
        left -= n
    return out


class VantagePointNeighbours:
    """k nearest neighbours by cosine of all valid vectors.

    Parameters: ``factor`` (1 is exact), ``sample``: vectors that shape the shards (all are indexed),
    ``shard``: aimed-at vectors of a shard, ``queries``: routed vectors that one task searches in a shard,
    ``room``: routed vectors of a round, as a multiple of all directions (a shard is never split over rounds).

    Defined results: null, all-zero and wrongly long vectors, those with null or non-finite numbers,
    and null ids take no part; an id stored again counts once (with its smallest ``record``); no id is
    its own neighbour; equal similarities go to the smaller id; vectors of one direction are searched
    once, so any share of the rows may be copies; with fewer than k + 1 ids all others are neighbours.
    """

    def __init__(self, dims: int = 128, k: int = 5, factor: float = 0.25, sample: int = 20_000, shard: int = 8192, queries: int = 65_536, room: float = 2.0, seed: int = 5):
        self.dims, self.k, self.factor, self.sample, self.shard, self.queries, self.room, self.seed = dims, k, factor, sample, shard, queries, room, seed

    def _valid(self, records: DataFrame, record: str, item: str, vector: str) -> DataFrame:
        """(id, vec, h, h2): the vectors' bytes as stored, one per id, and two hashes of their direction."""
        dims = self.dims
        kind = np.float32 if records.schema[vector].dataType.elementType.typeName() == "float" else np.float64

        def valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for i, no, v in zip(batch["id"], batch["no"], batch["v"]):
                    v = np.asarray(v, kind)
                    wide = v.astype(np.float64)
                    size = np.linalg.norm(wide)
                    if np.isfinite(size) and size > 0:
                        direction = (np.round(wide / size, DIGITS) + 0.0).tobytes()
                        out.append((i, no, v.tobytes(), *(xxhash.xxh64_intdigest(direction, k) - 2**63 for k in (1, 2))))
                yield pd.DataFrame(out, columns=["id", "no", "vec", "h", "h2"])

        rows = records.select(F.col(item).alias("id"), F.coalesce(F.col(record), F.lit(2**62)).alias("no"), F.col(vector).alias("v"))
        rows = rows.where((F.col("id").isNotNull()) & (F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull()))
        return (rows.mapInPandas(valid, "id long, no long, vec binary, h long, h2 long")
                .groupBy("id").agg(F.min_by(F.struct("vec", "h", "h2"), F.struct("no", "vec")).alias("v")).select("id", "v.*"))

    def _routes(self, tree: list[tuple], points: np.ndarray, reach: np.ndarray | None) -> list[np.ndarray]:
        """For each leaf of the shard tree the rows it gets: homes, or all that ``reach`` leaves."""
        leaves = [k for k, node in enumerate(tree) if len(node) == 1]
        number = {k: n for n, k in enumerate(leaves)}
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(leaves)
        stack = [(0, np.arange(len(points)))]
        while stack:
            at, who = stack.pop()
            node = tree[at]
            if len(node) == 1:
                out[number[at]] = who
                continue
            vantage, _, hi1, lo2, _, left, right = node
            angle, cut = _angles(points[who], vantage), (hi1 + lo2) / 2
            # The sample fixes only the cut between the children; stored vectors lie on either side of it.
            slack = 0 if reach is None else reach[who] * self.factor + 1e-6
            stack += [(left, who[angle <= cut + slack]), (right, who[angle > cut - slack])]
        return out

    def neighbours(self, records: DataFrame, record: str = "rec_no", item: str = "doc_id", vector: str = "embedding") -> DataFrame:
        """(id, neighbour, similarity): k rows per id."""
        spark, dims, k, seed = records.sparkSession, self.dims, self.k, self.seed
        valid = materialize(self._valid(records, record, item, vector), "vectors", tidy=True)
        named = materialize(valid.select("id", "h", "h2"), "named", tidy=True)
        # One entry per direction, with its k + 1 smallest ids; in salted steps, for copies may be many. Vectors stay where they are.
        least = lambda c: F.slice(F.array_sort(c), 1, k + 1)
        salted = named.groupBy("h", "h2", F.pmod(F.xxhash64("id"), F.lit(4096)).alias("salt")).agg(least(F.collect_list("id")).alias("ids"))
        for salts in (64, 1):
            salted = salted.groupBy("h", "h2", F.pmod("salt", F.lit(salts)).alias("salt")).agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
        groups = materialize(salted.select("h", "h2", "ids", F.element_at("ids", 1).alias("rep")), "directions", tidy=True)
        n = groups.count()
        part = min(1.0, 1.2 * self.sample / max(n, 1))
        some = groups.select("rep") if part >= 1 else groups.where(F.abs(F.hash("h", F.lit(seed)) / 2.0**31) < part).select("rep")
        some = some.limit(2 * self.sample)  # a bounded sample: it shapes the shards only
        some = valid.join(F.broadcast(some), F.col("id") == F.col("rep"), "left_semi").select("vec").collect()
        points = _unpack([r[0] for r in some], dims)
        shards = 1 << max(0, int(np.ceil(np.log2(max(n, 1) / self.shard))))
        tree = build(points, max(1, -(-len(points) // shards)), np.random.default_rng(seed))
        shared = spark.sparkContext.broadcast(tree)  # shards x dims numbers
        routes, factor, width = self._routes, self.factor, self.k + 3

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    shard = np.zeros(len(batch), np.int32)
                    for s, who in enumerate(routes(shared.value, _unpack(batch["vec"], dims), None)):
                        shard[who] = s
                    yield batch.assign(shard=shard)

        reps = groups.select("rep", F.size("ids").alias("copies")).join(valid.select(F.col("id").alias("rep"), "vec"), "rep").select("rep", "vec", "copies")
        placed = materialize(reps.mapInPandas(home, "rep long, vec binary, copies int, shard int"), "placed", tidy=True)
        release(valid)

        def first(pdf: pd.DataFrame) -> pd.DataFrame:
            vec, ids = _unpack(pdf["vec"], dims), pdf["rep"].to_numpy()
            search = _Search(vec, ids, width, factor, np.random.default_rng(seed))
            rows, sims = search.run(vec, ids, np.full(len(vec), np.inf))
            # Copies of the vector itself are its nearest; what they leave open bounds the reach.
            kth = np.sort(sims, axis=1)[:, ::-1][:, k - 1]
            reach = np.where(kth > -2, np.arccos(np.clip(kth, -1, 1)), np.pi)
            reach[pdf["copies"].to_numpy() > k] = 0
            sent = [(s, who[reach[who] > 0]) for s, who in enumerate(routes(shared.value, vec, reach)) if s != pdf["shard"].iloc[0]]
            who, to = np.concatenate([np.empty(0, np.int64), *(w for _, w in sent)]), np.repeat(np.array([s for s, _ in sent], np.int32), [len(w) for _, w in sent])
            ends = np.cumsum(np.bincount(who, minlength=len(vec)))[:-1]
            return pd.DataFrame({"rep": ids, "shard": pdf["shard"].to_numpy(), "vec": pdf["vec"].to_numpy(), "ids": [ids[r[s > -2]] for r, s in zip(rows, sims)],
                                 "sims": [s[s > -2] for s in sims], "reach": reach, "to": np.split(to[np.argsort(who, kind="stable")], ends)})

        schema = "rep long, shard int, vec binary, ids array<long>, sims array<double>, reach double, to array<int>"
        once = materialize(placed.groupBy("shard").applyInPandas(first, schema), "home", tidy=True)
        release(placed)

        def again(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(points) or not len(asked):
                return pd.DataFrame({"rep": [], "ids": [], "sims": []}, dtype=object)
            vec, ids = _unpack(points["vec"], dims), points["rep"].to_numpy()
            search = _Search(vec, ids, width, factor, np.random.default_rng(seed))
            rows, sims = search.run(_unpack(asked["vec"], dims), asked["rep"].to_numpy(), asked["reach"].to_numpy())
            # What is farther than the home shard's k-th can't be among the nearest.
            good = (sims > -2) & (sims >= np.cos(asked["reach"].to_numpy())[:, None] - 1e-9)
            return pd.DataFrame({"rep": asked["rep"].to_numpy(), "ids": [ids[r[g]] for r, g in zip(rows, good)], "sims": [s[g] for s, g in zip(sims, good)]})

        # A shard that many vectors ask for is searched by several tasks, each with the shard's points and a part of them.
        asks = once.select(F.explode("to").alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))
        asks = materialize(asks.withColumn("parts", F.ceil(F.col("n") / self.queries).cast("int")), "asks", tidy=True)
        parts, found = F.broadcast(asks.select("shard", "parts")), []
        for low, high in _rounds(sorted(asks.select("shard", "n").collect()), self.room * n):  # a row a shard
            routed = once.select("rep", "vec", "reach", F.explode(F.filter("to", lambda x: x.between(low, high))).alias("shard"))
            asked = routed.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts")
            points_of = once.where(F.col("shard").between(low, high)).join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            points_of = points_of.select(*[F.col(c).alias(c) for c in ("rep", "vec", "shard", "part")])  # columns of their own: both sides are of one table
            other = points_of.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(again, "rep long, ids array<long>, sims array<double>")
            found.append(materialize(other.where(F.size("ids") > 0), "found", tidy=True))
        both = once.select("rep", "ids", "sims")
        for other in found:
            both = both.unionByName(other)
        # At most (shards visited) x (k + 3) candidates a vector.
        near = (both.groupBy("rep").agg(F.flatten(F.collect_list(F.arrays_zip("sims", "ids"))).alias("c"))
                .select("rep", F.slice(F.array_sort(F.transform("c", lambda x: F.struct(F.round(-x["sims"], DIGITS).alias("less"), x["ids"].alias("id")))), 1, k).alias("c")))
        near = materialize(near, "near", tidy=True)
        release(once, *found)
        ids = groups.select("rep", "ids")
        pairs = near.select("rep", F.explode("c").alias("c")).select("rep", F.col("c.id").alias("near"), (-F.col("c.less")).alias("sim"))
        expanded = (pairs.join(ids.select(F.col("rep").alias("near"), F.col("ids").alias("near_ids")), "near")
                    .select("rep", "sim", "near_ids")
                    .unionByName(ids.select("rep", F.lit(1.0).alias("sim"), F.col("ids").alias("near_ids"))))
        # Per direction the best 2k + 1 ids; a member leaves itself out and keeps k.
        best = (expanded.select("rep", F.explode(F.transform("near_ids", lambda i: F.struct((-F.col("sim")).alias("less"), i.alias("id")))).alias("c"))
                .groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("c")), 1, 2 * k + 1).alias("c")))
        keyed = groups.select("rep", "h", "h2").join(best, "rep").drop("rep")
        members = named.join(keyed, ["h", "h2"])
        return (members.withColumn("c", F.slice(F.filter("c", lambda x: x["id"] != F.col("id")), 1, k))
                .select("id", F.explode("c").alias("c")).select("id", F.col("c.id").alias("neighbour"), (-F.col("c.less")).alias("similarity")))

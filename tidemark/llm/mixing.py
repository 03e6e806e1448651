"""Mixing sources to target weights (problem 9).

The documents of each source are dealt into blocks by hash; one small table holds the tokens of each
block. From it the quota of each source is drawn as whole blocks, and a splitting tree hands them to
the output shards: at each node the shards are halved and the left half's share of each source's
remaining blocks is a multivariate hypergeometric draw, so that every shard has its exact number of
blocks and every source is spent exactly. A shard takes the next blocks of each source's permuted
list, disjoint from all other shards, and is shuffled within itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize


def source_name(source: Column) -> Column:
    """Sources are compared trimmed and in lower case; no-break spaces are blanks."""
    return F.lower(F.trim(F.regexp_replace(source, "[ \\s]+", " ")))


def token_counts(spark: SparkSession, vocabulary: str):
    """For ``mapInPandas``: the rows with ``tokens``, counted with a public byte-level BPE vocabulary.

    The file is read here, once, and goes to the workers as a broadcast: they needn't have it.
    """
    import public_tokenizers

    with open(vocabulary, "rb") as source:
        shared = spark.sparkContext.broadcast((source.read(), public_tokenizers.PATTERN))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        lines, pattern = shared.value
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        coder = tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield batch.assign(tokens=[len(coder.encode_ordinary(text)) if text else 0 for text in batch["text"]])

    return run


def split_blocks(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): the leaves of the splitting tree.

    Shards get equal numbers of blocks up to one. A node's random numbers follow from the seed and
    its range of shards, so any branch can be computed alone.
    """
    total = int(quota.sum())
    edge = (np.arange(shards + 1) * total) // shards
    out = np.zeros((shards, len(quota)), np.int64)
    nodes = [(0, shards, quota.astype(np.int64))]
    while nodes:
        low, high, left = nodes.pop()
        if high - low == 1:
            out[low] = left
            continue
        mid = (low + high) // 2
        take = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(left, int(edge[mid] - edge[low]), method="marginals")
        nodes += [(low, mid, take), (mid, high, left - take)]
    return out


class SourceMixer:
    """Mixes documents so that each source has its target share of the tokens.

    ``max_blocks`` bounds the table of blocks, which is all that reaches the driver (with its draws:
    times the repeats); ``shard_tokens``: tokens of an output shard, from which their number follows,
    unless ``shards`` gives it.

    The total size is the tokens of all documents. A source gives ``target_share`` of it, repeated at
    most ``max_repeats`` times; a source that is too small gives all it may. Within one pass no
    document comes twice; a quota over one pass takes every block once before any comes again. The
    last block of a source is whole, so a share is met to within one block.

    Defined results: sources not among the targets, and null ones, count for the total but give
    nothing; a target without documents gives nothing and is short; null repeats count as one; a
    source given twice in the targets has its shares added and its larger repeats; null or empty
    texts have no tokens; null document ids can't be chosen but count; other columns are not read.
    """

    def __init__(self, vocabulary: str, shards: int | None = None, max_blocks: int = 16384, seed: int = 11, shard_tokens: int = 20_000_000):
        self.vocabulary, self.shards, self.max_blocks, self.seed, self.shard_tokens = vocabulary, shards, max_blocks, seed, shard_tokens

    def plan(self, documents: DataFrame, targets: DataFrame, texts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(report, draws, tokens of each document, with its text if ``texts``).

        Report: source, target_share, max_repeats, available (tokens), quota, drawn (tokens), actual_share
        (of the drawn tokens), share_of_total, short. Draws: source, block, pass, shard, place.
        """
        spark = documents.sparkSession
        sized = documents.select("doc_id", "source", "text").mapInPandas(token_counts(spark, self.vocabulary), "doc_id long, source string, text string, tokens long")
        sized = materialize((sized if texts else sized.drop("text")).withColumn("source", source_name(F.col("source"))), "tokens")
        wanted = (targets.withColumn("source", source_name(F.col("source"))).where("source is not null").groupBy("source")
                  .agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
                  .orderBy("source").toPandas())  # one row per source of the mix
        sums = {row["source"]: row["tokens"] for row in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
                .join(F.broadcast(spark.createDataFrame(wanted[["source"]], "source string")), "source").collect()}
        total = sized.agg(F.sum("tokens")).first()[0] or 0
        wanted["available"] = [int(sums.get(s, 0)) for s in wanted["source"]]
        known = max(1, int(wanted["available"].sum()))
        wanted["blocks"] = [max(1, int(self.max_blocks * a / known)) if a else 0 for a in wanted["available"]]
        sizes = spark.createDataFrame(wanted[["source", "blocks"]], "source string, blocks long")
        dealt = (sized.where("doc_id is not null").join(F.broadcast(sizes), "source")
                 .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.col("blocks"))))
        blocks = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).toPandas()  # at most max_blocks rows
        draws, drawn = [], []
        for k, row in enumerate(wanted.itertuples()):
            own = blocks[blocks["source"] == row.source].sort_values("block")
            quota = min(row.target_share * total, row.available * row.max_repeats)
            got, order = 0, []
            for again in range(int(row.max_repeats)):
                mixed = np.random.default_rng([self.seed, k, again]).permutation(len(own))
                for at in mixed:
                    if got >= quota:
                        break
                    got += int(own["tokens"].iloc[at])
                    order.append((int(own["block"].iloc[at]), again))
            draws.append(order)
            drawn.append(got)
        counts = np.array([len(order) for order in draws], np.int64)
        shards = self.shards or max(1, -(-int(sum(drawn)) // self.shard_tokens))
        leaves = split_blocks(counts, shards, self.seed) if counts.sum() else np.zeros((shards, len(counts)), np.int64)
        rows = []
        ends = leaves.cumsum(axis=0)
        for k, order in enumerate(draws):
            for shard in range(shards):
                low, high = int(ends[shard, k] - leaves[shard, k]), int(ends[shard, k])
                rows += [(wanted["source"].iloc[k], block, again, shard, low + i) for i, (block, again) in enumerate(order[low:high])]
        report = wanted.drop(columns="blocks").assign(
            quota=[min(s * total, a * r) for s, a, r in zip(wanted["target_share"], wanted["available"], wanted["max_repeats"])], drawn=drawn)
        report["actual_share"] = report["drawn"] / max(1, int(report["drawn"].sum()))
        report["share_of_total"] = report["drawn"] / max(1, total)
        # Short: every block was drawn as often as it may be, and the target still isn't reached.
        report["short"] = (report["drawn"] < report["target_share"] * total) & (report["drawn"] >= report["available"] * report["max_repeats"])
        report_df = spark.createDataFrame(report, "source string, target_share double, max_repeats int, available long, quota double, "
                                                  "drawn long, actual_share double, share_of_total double, short boolean")
        draws_df = spark.createDataFrame(pd.DataFrame(rows, columns=["source", "block", "pass", "shard", "place"]),
                                         "source string, block long, pass int, shard int, place long")
        return report_df, draws_df, dealt.select("doc_id", "source", "block", "tokens", *(["text"] if texts else []))

    def mix(self, documents: DataFrame, targets: DataFrame) -> DataFrame:
        """(shard, source, doc_id, pass, tokens, text): the mixed records, each shard in a partition of its own and shuffled."""
        _, draws, dealt = self.plan(documents, targets, texts=True)
        shards = int(draws.agg(F.max("shard")).first()[0] or 0) + 1
        # At most max_blocks times the repeats rows: bounded, so it may be broadcast.
        mixed = dealt.join(F.broadcast(draws), ["source", "block"])
        return (mixed.withColumn("__order", F.xxhash64("doc_id", "pass", F.lit(self.seed + 1)))
                .repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "__order")
                .select("shard", "source", "doc_id", "pass", "tokens", "text"))

"""One ranking from several differently-scaled scores (problem 6), by leximin order.

In each list an item's score becomes a percentile, so neither range nor tail matters. An item's
percentiles are sorted ascending and the arrays compared lexicographically from the weakest: an item
that one list places low can't make up for it elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize


def spread_rank(df: DataFrame, keys: list[str], order: list, name: str, ties: list | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with the 1-based place of each row in its group ``keys`` under ``order``, as column ``name``.

    A group may hold any share of all rows: rows are range-partitioned by keys and order, so that a
    large group lies in several partitions, which are ranked apart and shifted by the sizes of the
    group's earlier partitions. With ``ties`` (columns of ``order`` that decide a place), rows equal
    in them share the smallest place; equal rows always lie in one partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *(ties or order)).withColumn("__p", F.spark_partition_id())
    cut = materialize(cut, "ranges")  # the partition ids must stay as they are
    local = Window.partitionBy("__p", *keys)
    ranked = cut.withColumn("__r", (F.rank() if ties else F.row_number()).over(local.orderBy(*(ties or order))))
    # One row per partition and group that it holds; a partition adds rows only for groups it shares.
    sizes = cut.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where("__before > 0").drop("__n")
    match = [ranked["__p"] == shift["__p"], *[ranked[k].eqNullSafe(shift[k]) for k in keys]]
    return (ranked.join(shift, match, "left")
            .select(*[ranked[c] for c in df.columns], (F.col("__r") + F.coalesce("__before", F.lit(0))).alias(name)))


def leximin_ranking(lists: DataFrame, directions: DataFrame, query: str = "query_id", list_no: str = "list_no",
                    item: str = "doc_id", score: str = "score") -> DataFrame:
    """(query, item, place, percentiles): one ranking of each query's items.

    ``directions`` has ``list_no`` and ``higher_is_better`` (null or a list that it lacks: higher is
    better). It is a small table by nature, one row for each kind of score.

    Defined results: an item given twice in a list counts once with its better score; null and NaN
    scores place nothing; an item without a score in a list of its query gets percentile 0 there (a
    weak score can't be masked by leaving it out); equal scores share the better place; an item with
    no score at all isn't ranked; null queries, lists or items are ignored; equal arrays follow the
    item's number. Percentile: (n - place + 1) / n over the list's n distinct scored items.
    """
    rows = lists.select(F.col(query).alias("q"), F.col(list_no).alias("l"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
    rows = rows.where("q is not null and l is not null and i is not null and s is not null and not isnan(s)")
    ways = directions.groupBy(F.col(list_no).alias("l")).agg(F.max("higher_is_better").alias("up"))
    best = (rows.join(ways, "l", "left").withColumn("s", F.when(F.coalesce("up", F.lit(True)), F.col("s")).otherwise(-F.col("s")))
            .groupBy("q", "l", "i").agg(F.max("s").alias("s")))
    placed = spread_rank(best, ["q", "l"], [F.col("s").desc()], "place", ties=[F.col("s").desc()])
    placed = materialize(placed, "places")
    size = placed.groupBy("q", "l").agg(F.count("*").alias("n"))
    count = size.groupBy("q").agg(F.count("*").alias("lists"))
    own = (placed.join(size, ["q", "l"]).withColumn("pct", (F.col("n") - F.col("place") + 1) / F.col("n"))
           .groupBy("q", "i").agg(F.sort_array(F.collect_list("pct")).alias("own")))
    own = own.join(count, "q").select(
        "q", "i", F.concat(F.array_repeat(F.lit(0.0), F.col("lists").cast("int") - F.size("own")), F.col("own")).alias("percentiles"))
    ranked = spread_rank(own, ["q"], [F.col("percentiles").desc(), F.col("i").asc()], "place")
    return ranked.select(F.col("q").alias(query), F.col("i").alias(item), "place", "percentiles")

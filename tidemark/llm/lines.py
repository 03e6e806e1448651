"""Lines that one source repeats over its documents (problem 1).

Per source there are line-count tables, which grow by deltas: a new partition of documents adds a
delta of counts, the crossings of the threshold are found for the sources of that delta only, and
only the documents that hold a line with a changed verdict are built anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.store import DeltaStore
from tidemark.session import scratch_path

#: Stands for a null source; null sources form one source of their own.
NULL_SOURCE = "\u0000"


def normal_line(line: Column) -> Column:
    """Lower case, each run of digits as ``0``, each run of other non-letters as one blank, trimmed."""
    digits = F.regexp_replace(F.lower(line), r"\p{Nd}+", "0")
    return F.trim(F.regexp_replace(digits, r"[^\p{L}\p{N}]+", " "))


def _keyed_lines(docs: DataFrame, row: str, source: str, text: str) -> DataFrame:
    """(source_key, row_id, line_no, k1, k2): every line that has letters or digits.

    A line's key is 96 bits of hash, so that no text is shuffled.
    """
    cut = docs.select(
        F.xxhash64(F.coalesce(F.col(source), F.lit(NULL_SOURCE))).alias("source_key"),
        F.col(row).alias("row_id"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"),
    ).withColumn("line", normal_line("line"))
    return cut.where(F.col("line") != "").select(
        "source_key", "row_id", "line_no", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2")
    )


class SourceLineIndex:
    """Incremental line counts of each source, kept as delta tables under ``path``.

    A line is flagged in a source when it stands in at least ``min_rows`` rows and at least
    ``min_share`` of all rows of the source. Tables: ``lines`` (one row per line), ``sources`` (one per
    document), ``counts`` and ``rows`` (deltas of counts per line and per source) and ``verdicts``
    (changes of the flags). A merge is published whole: one whose job ended before is merged again.

    Defined results: a null or empty text has no lines but its row counts for the source; null
    sources are one source; a row id given twice in one delta counts once, and one that an earlier
    delta holds is ignored; a null row id is ignored; other columns are not read; empty tables
    give empty results.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_rows: int = 4, min_share: float = 0.1,
                 row: str = "fetch_no", source: str = "domain", text: str = "body"):
        self.spark, self.store = spark, DeltaStore(spark, path or scratch_path(spark, "source-lines"))
        self.min_rows, self.min_share = min_rows, min_share
        self.row, self.source, self.text = row, source, text

    def merge(self, docs: DataFrame) -> DataFrame:
        """Add a partition of documents; the row ids of all documents that must be built anew.

        These are the stored rows with a line whose verdict changed (it crossed the threshold
        either way, for a source's growth can also end a flag), new rows included.
        """
        attempt, keys = self.store.attempt(), ["source_key", "k1", "k2"]
        docs = docs.where(F.col(self.row).isNotNull())
        known = attempt.read("sources")
        again = known is not None
        if again:
            docs = docs.join(known.select(F.col("row_id").alias(self.row)), self.row, "left_anti")
        source = F.xxhash64(F.coalesce(F.col(self.source), F.lit(NULL_SOURCE))).alias("source_key")
        own = attempt.write(docs.select(source, F.col(self.row).alias("row_id")).distinct(), "sources")
        fresh = attempt.write(_keyed_lines(docs, self.row, self.source, self.text), "lines")
        # First once per row, then per line: both steps are combined before they are shuffled, and
        # the first spreads a large source over all tasks.
        counts = attempt.write(fresh.select(*keys, "row_id").distinct().groupBy(*keys).agg(F.count("*").alias("n")), "counts")
        rows = attempt.write(own.groupBy("source_key").agg(F.count("*").alias("rows")), "rows")
        before = self.flagged() if again else None
        if again:
            # Only the sources of this delta can change, and of each table only their rows go on.
            touched = rows.select("source_key")
            rows = attempt.read("rows").join(touched, "source_key", "left_semi").groupBy("source_key").agg(F.sum("rows").alias("rows"))
            counts = attempt.read("counts").join(touched, "source_key", "left_semi").groupBy(*keys).agg(F.sum("n").alias("n"))
            before = before.join(touched, "source_key", "left_semi")
        # A line under min_rows can't be flagged, and most lines are: they go before the join.
        now = (counts.where(F.col("n") >= self.min_rows).join(rows, "source_key")
               .where(F.col("n") >= self.min_share * F.col("rows")).select(*keys))
        if again:
            change = (now.join(before, keys, "left_anti").withColumn("sign", F.lit(1))
                      .unionByName(before.join(now, keys, "left_anti").withColumn("sign", F.lit(-1))))
        else:
            change = now.withColumn("sign", F.lit(1))
        changed = attempt.write(change, "verdicts")
        attempt.publish()
        return attempt.read("lines").join(changed, keys, "left_semi").select(F.col("row_id").alias(self.row)).distinct()

    def compact(self) -> None:
        """Add up the deltas of each table into one."""
        for table in ("lines", "sources", "counts", "rows", "verdicts"):
            self.store.compact(table)

    def flagged(self) -> DataFrame:
        """(source_key, k1, k2) of the lines that are flagged now."""
        verdicts = self.store.read("verdicts")
        return verdicts.groupBy("source_key", "k1", "k2").agg(F.sum("sign").alias("on")).where("on > 0").drop("on")

    def occurrences(self) -> DataFrame:
        """(row id, line_no) of every occurrence of a flagged line, each once."""
        return (self.store.read("lines").join(self.flagged(), ["source_key", "k1", "k2"], "left_semi")
                .select(F.col("row_id").alias(self.row), "line_no").distinct())

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with flagged lines removed from the text; other lines keep their order and form."""
        gone = self.occurrences().join(docs.select(self.row).distinct(), self.row, "left_semi").groupBy(self.row).agg(F.collect_set("line_no").alias("__gone"))
        lines = F.filter(F.split(F.col(self.text), "\n", -1), lambda line, i: ~F.array_contains("__gone", i))
        return (docs.join(gone, self.row, "left")
                .withColumn(self.text, F.when(F.col("__gone").isNull(), F.col(self.text)).otherwise(F.array_join(lines, "\n")))
                .drop("__gone"))

    def rebuild(self, docs: DataFrame, built: DataFrame | None, changed: DataFrame) -> DataFrame:
        """``built`` (cleaned documents so far) brought up to date: only new documents and those of ``changed`` are cleaned.

        ``docs`` are all documents merged so far, ``changed`` what ``merge`` returned.
        """
        if built is None:
            return self.clean(docs)
        kept = built.join(changed, self.row, "left_anti")
        return kept.unionByName(self.clean(docs.join(kept.select(self.row), self.row, "left_anti")))

"""Incremental ingestion: pages arrive in micro-batches and enter the index once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.operators.index import Index
from tidemark.sources.html import extract


def quality_gate(docs: DataFrame, least: float = 0.15) -> DataFrame:
    """Drops documents of low quality, homepages excepted."""
    return docs.where((text.quality(F.col("body")) >= least) | urls.is_homepage(F.col("url")))


def ingest_batch(index: Index, pages: DataFrame) -> int:
    """Extract, filter and index one batch of raw pages; returns the index version."""
    docs = quality_gate(extract(pages)).withColumnRenamed("id", "doc_id")
    return index.add(docs.select("doc_id", "url", "title", "body", "headings", "meta_description"))


def ingest_stream(spark: SparkSession, source: str, schema, index: Index, checkpoint: str, files_per_batch: int = 1):
    """Index the files that arrive in ``source``, as a streaming query over what is there now.

    The index ignores documents it holds, so a batch that is run again after a failure changes nothing.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (stream.writeStream.foreachBatch(lambda batch, _: ingest_batch(index, batch) and None)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

"""Streaming ingest: page-element files are chunked as they arrive, exactly once per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chunking import with_packs
from ..sources.pages import PAGE_SCHEMA


def stream_chunks(pages: DataFrame) -> DataFrame:
    """Text chunks of streaming pages: stateless, keyed by (source, page, chunk)."""
    packed = with_packs(pages, F.col("text"))
    return packed.select("source", "page", F.posexplode_outer("packs").alias("chunk", "c")).filter("chunk IS NOT NULL").select("source", "page", "chunk", F.col("c.text").alias("text"), F.col("c.n").alias("n_words"))


def start_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk all files that are in ``folder`` and not yet done, then stop."""
    pages = spark.readStream.schema(PAGE_SCHEMA).parquet(folder)
    return stream_chunks(pages).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

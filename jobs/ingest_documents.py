"""Incremental ingest: files of documents become evidence chunks as they arrive.

    python -m jobs.ingest_documents --documents PATH --out PATH --checkpoint PATH [--config FILE]

The input is a Parquet file or a folder of them (doc_id, text, lang, source); a file that
comes again under another name replaces the documents it holds.  A file stream
takes the files its checkpoint does not know, in batches, and stops when none is
left.  Each batch writes two tables below ``out``, into partitions of its own:

``pages``   a row per document: script, size and ``status``: text, blank,
            needs_ocr (too little text to be a whole page), no_id
            (partitions: batch, status)
``chunks``  the packed sentences of every document with text
            (partitions: batch, script)

A batch that is run again, because the run before died, overwrites its own
partitions with the same rows.  :func:`current` reads what is valid: of each
document the rows of its last batch (of texts of one id in one batch that with the
greatest hash).
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import dominant_script, once, strip, with_script_counts, word_count
from folioscope.operators.chunking import with_packs
from folioscope.sources.store import pattern

log = logging.getLogger("jobs.ingest_documents")

CONFIG = Path(__file__).with_suffix(".json")
INPUT = "doc_id long, text string, lang string, source string"
PAGES = "doc_id long, version long, source string, lang string, n_chars int, n_words int, script string, batch long, status string"
CHUNKS = "doc_id long, version long, chunk int, text string, n_words int, batch long, script string"


def read_config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def judged(documents: DataFrame, ocr_below: int) -> DataFrame:
    """``documents`` with version, script and status."""
    counted, counts = with_script_counts(documents, F.col("text"))
    counted = once(counted, F.length(strip(F.coalesce("text", F.lit("")))), "_bare")
    status = F.when(F.col("doc_id").isNull(), "no_id").when(F.col("_bare") == 0, "blank").when(F.col("_bare") < ocr_below, "needs_ocr").otherwise("text")
    script = dominant_script(F.col("text"), counts)
    return counted.withColumns({"version": F.xxhash64("text"), "script": script, "status": status}).drop("_n", "_bare")


def page_rows(documents: DataFrame) -> DataFrame:
    text: Column = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", "version", "source", "lang", F.length(text).alias("n_chars"), word_count(text).alias("n_words"), "script", "status")


def chunk_rows(documents: DataFrame, config: dict) -> DataFrame:
    """Packed sentences of documents that have text, however little."""
    held = documents.filter(F.col("status").isin("text", "needs_ocr"))
    packed = with_packs(held, F.col("text"), config["target_words"], config["least_words"], config["most_words"])
    rows = packed.select("doc_id", "version", "script", F.posexplode_outer("packs").alias("chunk", "c")).filter("chunk IS NOT NULL")
    return rows.select("doc_id", "version", "chunk", F.col("c.text").alias("text"), F.col("c.n").alias("n_words"), "script")


def _write(df: DataFrame, batch: int, path: str, by: str) -> None:
    """Into the partitions of this batch, replacing what an earlier try left there."""
    out = df.withColumn("batch", F.lit(batch).cast("long")).write.partitionBy("batch", by)
    out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def ingest(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> list[dict]:
    """Take in all new files; returns what each batch wrote: {batch, pages by status, chunks}."""
    config, done = config or read_config(), []

    def write(rows: DataFrame, batch: int) -> None:
        found = judged(rows, config["ocr_below_chars"])
        _write(page_rows(found), batch, f"{out}/pages", "status")
        _write(chunk_rows(found, config), batch, f"{out}/chunks", "script")
        own = lambda name, schema: rows.sparkSession.read.schema(schema).parquet(f"{out}/{name}").filter(F.col("batch") == batch)
        pages = {r["status"]: r["count"] for r in own("pages", PAGES).groupBy("status").count().collect()}  # four statuses
        done.append({"batch": batch, "pages": pages, "chunks": own("chunks", CHUNKS).count()})
        log.info("batch %d: read %d documents of %s, wrote %s pages and %d chunks to %s", batch, sum(pages.values()), documents, pages, done[-1]["chunks"], out)

    for name, schema, by in (("pages", PAGES, "status"), ("chunks", CHUNKS, "script")):  # there even if no file ever comes
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch", by).parquet(f"{out}/{name}")
    # A file's age says nothing about whether it is new here.
    files = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", config["files_per_batch"]).option("maxFileAge", "36500d").parquet(pattern(documents))
    stream = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    if not done:
        log.info("nothing new in %s", documents)
    return done


def current(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, source, lang, script, status, chunk, text, n_words): documents as they stand, those without chunks with nulls.

    Rows of documents without an id are not part of it; ``pages`` has them.
    """
    pages = spark.read.schema(PAGES).parquet(f"{out}/pages").filter("doc_id IS NOT NULL")
    last = pages.groupBy("doc_id").agg(F.max_by(F.struct("batch", "version", "source", "lang", "script", "status"), F.struct("batch", "version", "source", "lang")).alias("p")).select("doc_id", "p.*")
    key = ["doc_id", "batch", "version"]
    chunks = spark.read.schema(CHUNKS).parquet(f"{out}/chunks").drop("script").repartition(*key)  # one exchange for both
    met = last.join(chunks.dropDuplicates([*key, "chunk"]), key, "left")
    return met.select("doc_id", "source", "lang", "script", "status", "chunk", "text", "n_words")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("ingest_documents").getOrCreate()
    try:
        ingest(spark, a.documents, a.out, a.checkpoint, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

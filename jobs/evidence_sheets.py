"""Evidence sheets: a whole list of questions against a whole collection, in one batch.

    python -m jobs.evidence_sheets --documents PATH --questions PATH --out PATH [--config FILE]

Documents are Parquet (doc_id, text, lang, source), each one page; questions are
Parquet (item_id, text).  Below ``out`` the job writes

``index``     the postings of the documents (Parquet, partitioned by a hash of the term)
``evidence``  for each question its route, its intent and its best pages by BM25, one
              row a page; a question that no page shares a term with has one row
              without a page (Parquet, partitioned by route)
``sheets``    for each question with evidence its numbered blocks as one text, ready
              for a reader or a model (JSON lines, partitioned by route)

Every run writes all three anew from what the inputs hold, so a run that died is
simply run again.  Blank questions and questions without an id are left out, documents
without an id too; of rows of one question or document id the one with the smallest
text counts.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import routing
from folioscope.functions.text import strip
from folioscope.operators import evidence, retrieval
from folioscope.operators.inverted import InvertedIndex

log = logging.getLogger("jobs.evidence_sheets")

CONFIG = Path(__file__).with_suffix(".json")
#: Rows of results that may travel to the documents.
MOST_SENT = 500_000
EVIDENCE = "q_id long, question string, intent string, rank int, doc_id long, source string, lang string, bm25 double, evidence string, route string"


def read_config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, question, route, intent)."""
    rows = spark.read.parquet(path).select(F.col("item_id").cast("long").alias("q_id"), F.col("text").alias("question"))
    rows = rows.filter(F.col("q_id").isNotNull() & (strip(F.col("question")) != "")).groupBy("q_id").agg(F.min("question").alias("question"))
    return rows.withColumns({"route": routing.route(F.col("question")), "intent": routing.intent(F.col("question"))})


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, text, source, lang), one row an id; texts move only if ids repeat."""
    rows = spark.read.parquet(path).select(F.col("doc_id").cast("long").alias("chunk_id"), "text", "source", "lang").filter("chunk_id IS NOT NULL")
    if not rows.groupBy("chunk_id").count().filter("count > 1").limit(1).count():
        return rows
    return rows.groupBy("chunk_id").agg(F.min(F.struct("text", "source", "lang")).alias("r")).select("chunk_id", "r.*")


def write_sheets(spark: SparkSession, documents: str, questions: str, out: str, config: dict | None = None) -> dict:
    """Write index, evidence and sheets; returns how many documents and questions were read, and questions with evidence."""
    config = config or read_config()
    pages, asked = read_pages(spark, documents), read_questions(spark, questions)
    index = InvertedIndex.build(pages, f"{out}/index", config["range_width"], config["shelves"])
    log.info("read %d documents of %s, wrote their postings to %s/index", index.n_chunks, documents, out)

    best = retrieval.bm25_top(pages, asked.select("q_id", "question"), config["results"], index)
    if asked.count() * config["results"] <= MOST_SENT:
        best = F.broadcast(best)  # texts are looked up where they are, not moved
    met = pages.join(best, "chunk_id")
    met = met.select("q_id", "rank", F.col("chunk_id").alias("doc_id"), "source", "lang", "bm25", F.left(F.coalesce("text", F.lit("")), F.lit(config["evidence_chars"])).alias("evidence"))
    rows = asked.join(met, "q_id", "left")
    rows.select(*[f.split()[0] for f in EVIDENCE.split(", ")]).write.mode("overwrite").partitionBy("route").parquet(f"{out}/evidence")

    rows = spark.read.schema(EVIDENCE).parquet(f"{out}/evidence")
    found = rows.filter("rank IS NOT NULL").withColumns({"chunk_id": F.col("doc_id"), "page": F.lit(1), "region": F.lit("body"), "content_type": F.lit("text"), "text": F.col("evidence")})
    about = rows.groupBy("q_id").agg(*[F.first(c).alias(c) for c in ("question", "route", "intent")])
    sheets = about.join(evidence.evidence_context(found), "q_id")
    sheets.write.mode("overwrite").partitionBy("route").json(f"{out}/sheets")

    by_route = rows.groupBy("route").agg(F.count_distinct("q_id").alias("n"), F.count_distinct(F.when(F.col("rank").isNotNull(), F.col("q_id"))).alias("found")).collect()  # five routes
    for r in by_route:
        log.info("route %s: %d questions of %s, %d with evidence, written to %s", r["route"], r["n"], questions, r["found"], out)
    return {"documents": index.n_chunks, "questions": sum(r["n"] for r in by_route), "found": sum(r["found"] for r in by_route)}


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "questions", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("evidence_sheets").getOrCreate()
    try:
        write_sheets(spark, a.documents, a.questions, a.out, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

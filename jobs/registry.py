"""Queries ``jobN_<name>``: each job run twice over the whole tables, and its output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import queries as core
from folioscope.sources.store import new_folder

from . import evidence_sheets, ingest_documents


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks; the second run finds nothing new."""
    folder = new_folder(spark, "job1-ingest-documents")
    for _ in range(2):
        ingest_documents.ingest(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return ingest_documents.current(spark, f"{folder}/out")


def job2_evidence_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pages for every question; the second run writes the same again."""
    out = new_folder(spark, "job2-evidence-sheets")
    for _ in range(2):
        evidence_sheets.write_sheets(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    found = spark.read.schema(evidence_sheets.EVIDENCE).parquet(f"{out}/evidence")
    return found.withColumn("bm25", F.round("bm25", 6))


QUERIES = {f.__name__: f for f in (job1_ingest_documents, job2_evidence_sheets)}

_S = core.s_script("text")
_TOP = f"greatest({_S['latin']}, {_S['hindi']}, {_S['kannada']})"
_BARE = core.s_strip("coalesce(text, '')")

ORACLES = {
    "job1_ingest_documents": f"""
        WITH d AS (
            SELECT doc_id, source, lang,
                   CASE WHEN {_TOP} = 0 THEN CASE WHEN {_S['digits']} > 0 THEN 'latin' ELSE 'unknown' END
                        WHEN {_S['latin']} = {_TOP} THEN 'latin' WHEN {_S['hindi']} = {_TOP} THEN 'hindi' ELSE 'kannada' END AS script,
                   CASE WHEN length({_BARE}) = 0 THEN 'blank' WHEN length({_BARE}) < 40 THEN 'needs_ocr' ELSE 'text' END AS status,
                   {core.s_sentences('text')} AS s
            FROM documents
        ), packed AS (
            SELECT doc_id, {core.s_packs('s')} AS p FROM d WHERE len(s) > 0
        ), chunks AS (
            SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk, p[i].text AS text, CAST(p[i].n AS INTEGER) AS n_words
            FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM packed)
        )
        SELECT doc_id, source, lang, script, status, chunk, chunks.text, n_words FROM d LEFT JOIN chunks USING (doc_id)
    """,
    "job2_evidence_sheets": f"""
        WITH q AS (
            SELECT item_id AS q_id, text AS question, {core.s_route('text')} AS route, {core.s_intent('text', ())} AS intent
            FROM benchmark WHERE {_BARE} <> ''
        ), best AS (
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(bm25, 6) DESC, chunk_id) AS rank FROM {core.s_bm25('(SELECT item_id AS q_id, text AS question FROM benchmark)')}
            ) WHERE rank <= 5
        )
        SELECT q_id, question, intent, CAST(rank AS INTEGER) AS rank, doc_id, source, lang, round(bm25, 6) AS bm25, left(text, 1800) AS evidence, route
        FROM q LEFT JOIN (SELECT best.*, doc_id, source, lang, text FROM best JOIN documents ON chunk_id = doc_id) USING (q_id)
    """,
}

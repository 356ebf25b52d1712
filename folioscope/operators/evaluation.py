"""Evaluation of answers, and ingestion summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_eval

PASS = 0.70


def eval_terms(cases: DataFrame) -> DataFrame:
    """Add score, passed, matched and missing to (answer, expected_terms) rows."""
    answer = normalize_eval(F.col("answer"))
    hit = lambda t: F.contains(answer, normalize_eval(t))
    df = cases.withColumn("matched", F.filter("expected_terms", hit)).withColumn("missing", F.filter("expected_terms", lambda t: ~hit(t)))
    df = df.withColumn("score", F.coalesce(F.try_divide(F.size("matched"), F.size("expected_terms")), F.lit(0.0)))
    return df.withColumn("passed", F.col("score") >= PASS)


def eval_summary(results: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if("passed")
    return results.agg(n.alias("total"), ok.alias("n_passed"), (n - ok).alias("n_failed"), F.coalesce(F.try_divide(ok * 100.0, n), F.lit(0.0)).alias("accuracy"))


def eval_by_category(results: DataFrame) -> DataFrame:
    """Per category and, with category null, over all."""
    n, ok = F.count(F.lit(1)), F.count_if("passed")
    return results.rollup("category").agg(n.alias("total"), ok.alias("n_passed"), (ok * 100.0 / n).alias("accuracy"))


def ingest_summary(pages: DataFrame) -> DataFrame:
    """Documents, pages, OCR pages, images and tables; mean OCR scores over pages that used it."""
    over = lambda c: F.coalesce(F.avg(F.when(F.col("ocr_used") & (F.col(c) > 0), F.col(c))), F.lit(0.0))
    return pages.agg(
        F.count_distinct("source").alias("n_documents"), F.count(F.lit(1)).alias("n_pages"), F.count_if("ocr_used").alias("n_ocr"), F.sum("image_count").alias("n_images"), F.sum("table_count").alias("n_tables"),
        F.count_if(F.col("page_image").isNotNull()).alias("n_rendered"), over("ocr_confidence").alias("mean_confidence"), over("ocr_quality").alias("mean_quality"),
    )

"""OCR quality scores and candidate checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Counts, normalize_ws, script_characters, script_counts, script_purity, strip, words

_USEFUL = r"[^\p{L}\p{N}\s.,;:!?()\-/%₹$€£]"


def text_quality(text: Column, confidence: Column) -> Column:
    """Page-level quality in [0, 1]; confidence is 0 to 100."""
    s = strip(F.coalesce(text, F.lit("")))
    n, w = F.length(s), words(s)
    useful = F.try_divide(F.length(F.regexp_replace(s, f"(?U){_USEFUL}", "")), n)
    short = F.when(n < 20, 0.10).when(n < 50, 0.45).when(n < 100, 0.75).otherwise(1.0)
    share = F.try_divide(F.size(F.array_distinct(w)), F.size(w))
    again = F.when(F.size(w) < 10, 1.0).when(share < 0.20, 0.45).when(share < 0.35, 0.70).otherwise(1.0)
    raw = confidence / 100.0 * 0.40 + useful * 0.20 + F.least(F.size(w) / 80.0, F.lit(1.0)) * 0.15 + F.least(n / 500.0, F.lit(1.0)) * 0.25
    return F.when(n == 0, 0.0).otherwise(F.round(raw * short * again + 1e-9, 4))  # ties up


def line_quality(text: Column, confidence: Column, language: Column, counts: Counts | None = None) -> Column:
    """Line-level quality; confidence is 0 to 1, ``counts`` are the text's by script where they are known."""
    s = normalize_ws(text)
    n = counts or script_counts(s)
    total = sum(n.values(), F.lit(0))
    meaning = F.try_divide(total - n["other"], total)
    purity = script_purity(s, language, n)
    bucket = F.when(purity < 0.20, 0.0).when(purity < 0.40, 0.20).when(purity < 0.60, 0.50).when(purity < 0.80, 0.80).otherwise(1.0)
    raw = confidence * 0.40 + meaning * 0.30 + F.least(F.length(s) / 40.0, F.lit(1.0)) * 0.10 + bucket * 0.20
    return F.when(total == 0, 0.0).otherwise(raw)


def valid_candidate(text: Column, confidence: Column, language: Column, counts: Counts | None = None) -> Column:
    """Whether a line recogniser's result is worth comparing."""
    s = strip(F.coalesce(text, F.lit("")))
    n = counts or script_counts(s)
    some = sum(n.values(), F.lit(0)) > 0  # a character that is no white space
    purity, own = script_purity(s, language, n), script_characters(s, language, n)
    script = (
        F.when(language.isin("hindi", "kannada"), (own >= 2) & (purity >= 0.30))
        .when(language == "latin", (own >= 1) & (purity >= 0.20))
        .otherwise(True)
    )
    return some & (F.coalesce(confidence, F.lit(0.0)) >= 0.20) & script


def vertical_overlap(top_a: Column, bottom_a: Column, top_b: Column, bottom_b: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(bottom_a, bottom_b) - F.greatest(top_a, top_b))
    low = F.least(F.greatest(F.lit(1), bottom_a - top_a), F.greatest(F.lit(1), bottom_b - top_b))
    return shared / low

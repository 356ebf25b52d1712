"""Embedding of chunks, and the vector index with its integrity checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .retrieval import dot

Encoder = Callable[[list[str]], np.ndarray]
# Fixed value: the instruction that the public encoder was trained to see before a question.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def hashing_encoder(texts: list[str], dims: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed hashed words, unit norm."""
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = crc32(w.encode())
            out[i, h % dims] += 1 if h & 1 << 20 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embeddable(chunks: DataFrame) -> DataFrame:
    """Text and table chunks that are not blank."""
    return chunks.filter(F.coalesce("content_type", F.lit("text")).isin("text", "table") & (strip(F.coalesce("text", F.lit(""))) != ""))


def encode(chunks: DataFrame, encoder: Encoder = hashing_encoder, batch: int = 16, prefix: str = "") -> DataFrame:
    """(chunk_id, vector) of embeddable chunks; an encoder is loaded once per worker batch stream."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [prefix + t for t in pdf["text"]]
            parts = [encoder(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            vectors = [v.astype(np.float32) for p in parts for v in p]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "vector": vectors})

    return embeddable(chunks).select("chunk_id", "text").mapInPandas(run, "chunk_id long, vector array<float>")


def embed_stats(chunks: DataFrame) -> DataFrame:
    """Chunks by content type, and how many of each are embedded."""
    ok = F.coalesce("content_type", F.lit("text")).isin("text", "table") & (strip(F.coalesce("text", F.lit(""))) != "")
    return chunks.groupBy(F.coalesce("content_type", F.lit("text")).alias("content_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_embedded"))


def norm_stats(vectors: DataFrame, column: str = "vector") -> DataFrame:
    n = F.sqrt(dot(F.col(column), F.col(column)))
    return vectors.select(n.alias("n")).agg(F.avg("n").alias("mean_norm"), F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.count("n").alias("n_vectors"))


def vector_store(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors with the metadata of their chunks."""
    return vectors.join(chunks.drop("images", "tables", "page_image"), "chunk_id")


def vector_stats(store: DataFrame) -> DataFrame:
    """Vectors by content type and by source in one pass."""
    out = store.groupingSets([["content_type"], ["source"]], "content_type", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("ocr_used").alias("n_ocr"), F.grouping_id().alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "content_type").otherwise("source").alias("by"), F.coalesce("content_type", "source").alias("value"), "n", "n_ocr")


def integrity_report(chunks: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(check, severity, violations): one row per rule of a vector index."""
    rule = lambda name, severity, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "violations")
    rules = [
        rule("vector_without_chunk", "error", vectors.join(chunks, "chunk_id", "left_anti")),
        rule("chunk_without_vector", "warn", embeddable(chunks).join(vectors, "chunk_id", "left_anti")),
        rule("duplicate_vector_id", "error", vectors.groupBy("chunk_id").count().filter("count > 1")),
        rule("duplicate_chunk_key", "error", chunks.groupBy("source", "page", "chunk_id").count().filter("count > 1")),
        rule("wrong_dimension", "error", vectors.filter(F.coalesce(F.size("vector"), F.lit(-1)) != dims)),
        rule("not_unit_norm", "warn", vectors.filter(F.abs(F.sqrt(dot(F.col("vector"), F.col("vector"))) - 1) > 1e-3)),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def assert_integrity(report: DataFrame) -> None:
    """Raise if a rule of severity error is violated (the report has six rows)."""
    bad = [(r["check"], r["violations"]) for r in report.filter("severity = 'error' AND violations > 0").collect()]
    if bad:
        raise ValueError(f"index is not sound: {bad}")

"""Versions of an index: folders that are written whole, and a manifest that names them.

A version is a folder with ``chunks``, ``vectors``, ``postings`` and ``cells``.  It
counts from the moment its one row is appended to ``manifest``, which is the last
thing that is written: a run that dies before leaves the version before it in force,
and whoever has opened that one goes on reading its folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding
from ..operators.inverted import InvertedIndex
from ..operators.vector_index import VectorIndex
from ..sources.pages import write_table
from ..sources.store import delete

MANIFEST = "version long, folder string, n_chunks long, n_vectors long"


class Version:
    """One version, opened: its tables and its indexes."""

    def __init__(self, spark: SparkSession, path: str, number: int, folder: str):
        self.number, at = number, f"{path}/{folder}"
        self.chunks, self.vectors = spark.read.parquet(f"{at}/chunks"), spark.read.parquet(f"{at}/vectors")
        self.postings, self.cells = InvertedIndex.open(spark, f"{at}/postings"), VectorIndex.open(spark, f"{at}/cells")


def manifest(spark: SparkSession, path: str) -> list:
    """(version, folder, ...), oldest first; empty if nothing was ever written there."""
    try:
        return sorted(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect(), key=lambda r: (r["version"], r["folder"]))  # a row a version
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def open_latest(spark: SparkSession, path: str) -> Version:
    known = manifest(spark, path)
    if not known:
        raise ValueError(f"there is no index at {path}")
    return Version(spark, path, known[-1]["version"], known[-1]["folder"])


#: What a new version goes through, in this order.
STEPS = ("chunks", "vectors", "checks", "postings", "cells", "manifest")


def write_version(chunks: DataFrame, path: str, encoder: embedding.Encoder, vectors: DataFrame | None = None, begin: Callable[[str], None] = lambda step: None) -> int:
    """Write ``chunks`` with ``vectors``, and the vectors of those chunks that have none there, as the next version.

    An unsound index raises and is not named by the manifest.  ``begin`` is told
    each of ``STEPS`` as it begins.
    """
    spark = chunks.sparkSession
    number = max((r["version"] for r in manifest(spark, path)), default=0) + 1
    folder = f"version-{number:06d}-{uuid.uuid4().hex[:8]}"  # two writers never share one
    at = f"{path}/{folder}"
    begin("chunks")
    write_table(chunks, f"{at}/chunks")
    chunks = spark.read.parquet(f"{at}/chunks")
    new = chunks if vectors is None else chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    begin("vectors")
    made = embedding.encode(new, encoder)
    write_table(made if vectors is None else vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi").unionByName(made), f"{at}/vectors")
    vectors = spark.read.parquet(f"{at}/vectors")
    begin("checks")
    dims = vectors.select(F.size("vector").alias("n")).first()
    if dims is None:
        raise ValueError("no chunk could be embedded")
    embedding.assert_integrity(embedding.integrity_report(chunks, vectors, dims["n"]))
    begin("postings")
    postings = InvertedIndex.build(chunks, f"{at}/postings")
    begin("cells")
    cells = VectorIndex.build(vectors, f"{at}/cells")
    begin("manifest")
    row = spark.createDataFrame([(number, folder, postings.n_chunks, cells.n_vectors)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return number


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the folders of all but the last ``keep`` versions, which nobody may be reading; returns them."""
    old = [r["folder"] for r in manifest(spark, path)[:-keep]]
    for folder in old:
        delete(spark, f"{path}/{folder}")
    return old

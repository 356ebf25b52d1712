"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, trimmed


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and, for each, the smallest node it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        apart = la != lb
        if not apart.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(label, up := label[label]):
            label = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            node, root = forest(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            keep = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["u", "v"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns).

    ``component`` is the smallest node reachable.  Links are first contracted
    within batches, then alternating large-star and small-star rounds (Kiveris
    et al. 2014) run until no link changes.  Minima are combined before the
    shuffle and the joins back are plain equi-joins whose hot side can be
    split, so a node of any degree is fine.  Each round is cut by a written
    table.  No rows in, no rows out; nulls are ignored.
    """
    ship(links.sparkSession)
    a, b = links.columns[:2]
    # Links often come from Python; written first, no task runs two workers.
    edges = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna(), "links")
    edges, before = materialize(edges.mapInArrow(trimmed(_contract), "u long, v long").distinct(), "links"), None
    while True:  # each round halves what is left, so there are some log n of them
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
        large = both.join(least, both["u"] == least["_u"]).filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("_m")).withColumnRenamed("u", "_u")
        hung = large.join(low, large["u"] == low["_u"])
        small = hung.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
    roots = edges.groupBy("v").agg(F.lit(1).alias("_")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

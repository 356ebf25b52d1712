"""Near-duplicate embeddings: int8 tile products with rigorous error bounds.

Vectors of one label are dealt into blocks; every pair of blocks is a tile.  A
tile multiplies int8-quantised unit vectors (8-bit factors, 32-bit sums), adds
to each product the bound that the two quantisation errors allow, and recomputes
in double precision only the pairs that may reach the threshold.  It does so in
strips of rows and slices of pairs, so its memory does not depend on how many
pairs are close.  What leaves a tile is one row per linked vector (how many
links, and one link of a spanning forest), never pairs.

Equal vectors are one representative with a multiplicity, so thousands of
copies cost one row.  Work per label is quadratic in its distinct vectors, as
an exact comparison under a cosine threshold is in the worst case; it is spread
over (n / block)^2 / 2 tiles of fixed size.

Edge cases: null, zero, null-holding or non-finite vectors and null labels link
with nothing and are kept; vectors of different lengths do not compare, and may
be very long; a cosine equal to the threshold links; rows that repeat an id
count as vectors of their own; an empty table gives an empty result; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .components import connected_components, forest


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as (int8 codes, scales, norms of what rounding left out)."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


#: Rows of a strip, and bytes of vectors gathered for a slice of pairs.
STRIP, SLICE_BYTES = 64, 16_000_000


def close_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Index pairs with cosine >= threshold (y None: i < j within x), slice by slice, and how many were recomputed.

    With u = a + d and v = b + e (a, b quantised), |u.v - a.b| <= |a||e| + |d||v|,
    |v| = 1 and |a| <= 1 + |d|; a slack of 1e-6 covers float rounding.
    """
    same = y is None
    y = x if same else y
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex = quantise(x / nx[:, None])
    qy, sy, ey = (qx, sx, ex) if same else quantise(y / ny[:, None])
    most = max(1, SLICE_BYTES // (16 * x.shape[1]))
    for top in range(0, len(x), STRIP):
        strip = slice(top, top + STRIP)
        products = np.einsum("ik,jk->ij", qx[strip], qy, dtype=np.int32)
        approx = products * sx[strip, None] * sy
        i, j = np.nonzero(approx + (1 + ex[strip, None]) * ey + ex[strip, None] + 1e-6 >= threshold)
        i = i + top
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), most):
            a, b = i[at : at + most], j[at : at + most]
            hit = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
            yield a[hit], b[hit], len(a)


def _tile(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key[2], key[3]
        ids, n = pdf["rep"].to_numpy(), pdf["n"].to_numpy()
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        a = np.flatnonzero(pdf["block"].to_numpy() == low)
        b = a if low == high else np.flatnonzero(pdf["block"].to_numpy() == high)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j, _ in close_pairs(x[a], None if low == high else x[b], threshold):
            i, j = a[i], b[j]
            links += (np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))).astype(np.int64)
            apart = label[i] != label[j]
            if apart.any():  # contract what is found so far
                node, root = forest(label[i[apart]], label[j[apart]])
                up = np.arange(len(ids))
                up[node] = root
                label = up[label]
        at = np.flatnonzero(links)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        return pd.DataFrame({"rep": ids[at], "links": links[at], "root": least[label[at]]})

    return run


def link_embeddings(df: DataFrame, threshold: float = 0.98, block: int = 1_024) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label)."""
    ship(df.sparkSession)
    rows = df.select("vec_id", "embedding", "label")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    good = rows.filter("_ok")
    reps = materialize(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    reps = reps.withColumn("dim", F.size("embedding"))
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep"), "_nb").cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "_o")).withColumn("high", F.greatest("block", "_o"))
    tiles = dealt.select("label", "dim", "low", "high", "block", "rep", "n", "embedding").groupBy("label", "dim", "low", "high")
    found = materialize(tiles.applyInPandas(_tile(threshold), "rep long, links long, root long"), "vector-links")
    parts = connected_components(found.filter("rep <> root").select("rep", "root"))
    links = found.groupBy("rep").agg(F.sum("links").alias("_l")).withColumnRenamed("rep", "_r")
    known = reps.join(links, reps["rep"] == links["_r"], "left").drop("_r")
    known = known.join(parts, known["rep"] == parts["node"], "left")
    known = known.select(F.col("label").alias("_lb"), F.col("embedding").alias("_e"), F.coalesce("component", "rep").alias("_c"), (F.coalesce("_l", F.lit(0)) + F.col("n") - 1).alias("_n"))
    out = rows.join(known, rows["_ok"] & (rows["label"] == known["_lb"]) & (rows["embedding"] == known["_e"]), "left")
    out = out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

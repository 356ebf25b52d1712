"""Pruned vector search against all products."""

import numpy as np
import pytest

from folioscope.operators import retrieval, vector_index
from folioscope.operators.vector_index import VectorIndex

ROWS = "chunk_id long, vector array<double>"


def clustered(rng, n, dims=16, groups=25, spread=0.05):
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frames(spark, x, q):
    vectors = spark.createDataFrame([(int(i) * 7 % 10_007, v.tolist()) for i, v in enumerate(x)], ROWS).repartition(4)
    return vectors, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q_id long, vector array<double>")


def brute(x, q, k):
    score = q @ x.T
    ids = np.arange(len(x)) * 7 % 10_007
    return {(i, rank + 1): (int(ids[j]), score[i, j]) for i in range(len(q)) for rank, j in enumerate(np.lexsort((ids, -score[i]))[:k])}


def ranked(df):
    return {(r["q_id"], r["rank"]): (r["chunk_id"], pytest.approx(r["score"])) for r in df.collect()}


@pytest.mark.parametrize("kind", ["clustered", "random", "long", "copies"])
def test_search_is_exact(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    x = clustered(rng, 1_500) if kind == "clustered" else rng.normal(size=(600, 8))
    if kind == "long":
        x *= rng.lognormal(0, 2, size=(len(x), 1))
    if kind == "copies":
        x[: len(x) // 3] = x[0]  # a third of all rows: ties everywhere
    q = np.concatenate([x[rng.integers(0, len(x), 12)], rng.normal(size=(5, x.shape[1])), np.zeros((1, x.shape[1]))])
    vectors, asked = frames(spark, x, q)
    VectorIndex.build(vectors, str(tmp_path), cell_rows=40)
    index = VectorIndex.open(spark, str(tmp_path))
    assert index.n_vectors == len(x) and index.n_cells > 5
    for k in (1, 7):
        got = ranked(retrieval.similarities(vectors, asked, k, index))
        assert got == {k: v for k, v in brute(x, q, k).items()}


def test_bounds_hold_and_cells_are_skipped(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = clustered(rng, 3_000)
    vectors, asked = frames(spark, x, x[:20])
    index = VectorIndex.build(vectors, str(tmp_path), cell_rows=60)
    search = index.search(asked, 5)
    cell = {r["cell"]: j for j, r in enumerate(index.cells().orderBy("cell").collect())}
    for r in index.vectors.collect():
        assert (search.bounds[:, cell[r["cell"]]] >= search.q @ np.array(r["vector"])).all()
    assert search.best().count() >= 100
    assert search.share() < 0.25  # of the products that a full scan makes


def test_index_of_odd_rows_and_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (3, [0.0, 2.0])], ROWS)
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "q_id long, vector array<double>")
    index = VectorIndex.build(rows, f"{tmp_path}/a")
    assert index.n_vectors == 2
    assert [(r["q_id"], r["chunk_id"]) for r in sorted(retrieval.similarities(rows, asked, 5, index).collect(), key=lambda r: r["rank"])] == [(1, 3), (1, 1)]
    none = VectorIndex.build(rows.limit(0), f"{tmp_path}/b")
    assert none.n_vectors == 0 and retrieval.similarities(rows, asked, 5, VectorIndex.open(spark, f"{tmp_path}/b")).collect() == []
    assert retrieval.similarities(rows, asked.limit(0), 5, index).collect() == []


def test_fit_gives_centres_of_separate_groups():
    rng = np.random.default_rng(1)
    x = clustered(rng, 800, groups=4, spread=0.01)
    centres = vector_index.fit(x, 12)
    assert np.sqrt(((x - centres[vector_index.nearest(x, centres)]) ** 2).sum(axis=1)).max() < 0.3
    assert len(vector_index.fit(np.ones((50, 3)), 7)) == 1

"""A stored vector index whose search is exact and opens only cells that may hold a best vector.

Two Parquet tables and a row of facts lie below one path:

``vectors``  (cell, chunk_id, vector, away): every vector with the cell of its nearest
             centre and its distance from it, partitioned by cell
``cells``    (cell, centre, radius, n): no vector of the cell lies further than
             ``radius`` from its centre
``facts``    vectors, cells

Centres are fitted by k-means on a bounded sample (``SAMPLE`` vectors, the first by a
hash of their id); there is one for about ``CELL_ROWS`` vectors and at most
``MOST_CELLS``.  They only decide how much a search can skip: for any centre c and
vector x of its cell q.x = q.c + q.(x - c) <= q.c + |q| radius, so a cell whose bound
lies below a question's k-th best product so far cannot better it.

Edge cases: null vectors and vectors without an id are not indexed; vectors need not
have unit norm; any number of copies may crowd a cell, which then is read by several
tasks; an empty table gives an index in which nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .topk import Best

SAMPLE, CELL_ROWS, MOST_CELLS, ROUNDS = 20_000, 2_000, 4_096, 8
#: Rows of one cell that a task writes.
ROWS_A_TASK = 1_000_000
#: Rows scored at a time.
SLICE = 512
FACTS = "n_vectors long, n_cells int, kind string"
CELLS = "cell int, centre array<double>, radius double, n long"


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)


def fit(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centres by k-means, from rows spread over the sample."""
    centres = np.unique(x[np.linspace(0, len(x) - 1, k).astype(int)], axis=0)
    for _ in range(rounds):
        at = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class VectorIndex:
    """An index at ``path``."""

    spark: SparkSession
    path: str
    n_vectors: int
    n_cells: int
    kind: str

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark, path, **spark.read.schema(FACTS).parquet(f"{path}/facts").first().asDict())

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cell_rows: int = CELL_ROWS) -> VectorIndex:
        """Write the index of (chunk_id, vector); the facts come last, so an index without them is not whole."""
        spark = vectors.sparkSession
        sound = vectors.filter(F.col("chunk_id").isNotNull() & F.col("vector").isNotNull()).select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector")
        made = cls(spark, path, 0, 0, sound.schema["vector"].dataType.simpleString())
        n = sound.count()
        sample = sound.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).collect() if n else []  # bounded
        centres = fit(np.array([r["vector"] for r in sample], np.float64), max(1, min(MOST_CELLS, n // cell_rows, len(sample) // 4))) if n else np.zeros((0, 0))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(1))
                    at = nearest(x, centres)
                    away = np.sqrt(((x - centres[at]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(away), pa.array(at.astype(np.int32))], ["chunk_id", "vector", "away", "cell"])

        placed = sound.mapInArrow(assign, made.schema())
        dealt = placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(1 + n // ROWS_A_TASK)))
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        held = made.vectors.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
        met = held.join(spark.createDataFrame(list(enumerate(centres.tolist())), "cell int, centre array<double>"), "cell").select("cell", "centre", "radius", "n")
        met.write.mode("overwrite").parquet(f"{path}/cells")
        made.n_vectors, made.n_cells = n, len(centres)
        spark.createDataFrame([(n, len(centres), made.kind)], FACTS).write.mode("overwrite").parquet(f"{path}/facts")
        return made

    def schema(self) -> str:
        return f"chunk_id long, vector {self.kind}, away double, cell int"

    @cached_property
    def vectors(self) -> DataFrame:
        """The vectors' table; its files are listed once."""
        return self.spark.read.schema(self.schema()).parquet(f"{self.path}/vectors")

    def cells(self) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(f"{self.path}/cells")

    @cached_property
    def held_cells(self) -> list:
        """The cells on the driver: at most ``MOST_CELLS``."""
        return self.cells().orderBy("cell").collect()

    def search(self, block: DataFrame, k: int, probe: int = 2) -> VectorSearch:
        """A search for a block of questions (q_id, vector): see :class:`VectorSearch`."""
        return VectorSearch(self, block, k, probe)


class VectorSearch:
    """The k best vectors of each question of a block, in two rounds.

    The first opens the ``probe`` cells of the highest bounds of every question, the
    second those that may still hold one of the k best.  A cell is read once for all
    questions that open it; tasks pass on k rows a question.
    """

    def __init__(self, index: VectorIndex, block: DataFrame, k: int, probe: int):
        self.index, self.k = index, k
        rows = block.select("q_id", "vector").filter("vector IS NOT NULL").orderBy("q_id").collect()  # a block: bounded
        self.ids = np.array([r["q_id"] for r in rows], np.int64)
        self.q = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["vector"]) if rows else 0)
        cells = index.held_cells
        self.cells, self.sizes = np.array([c["cell"] for c in cells], np.int64), np.array([c["n"] for c in cells], np.int64)
        self.bounds = np.zeros((len(rows), len(cells)))
        if rows and cells:
            centre, radius = np.array([c["centre"] for c in cells]), np.array([c["radius"] for c in cells])
            size = np.linalg.norm(self.q, axis=1)[:, None]
            slack = 1e-9 * (1 + size * (np.linalg.norm(centre, axis=1) + radius))  # of rounding
            self.bounds = self.q @ centre.T + size * radius + slack
        first = min(probe, len(cells))
        self.first = np.zeros(self.bounds.shape, bool)
        np.put_along_axis(self.first, np.argsort(-self.bounds, axis=1)[:, :first], True, axis=1)
        self.opened = self.first

    def best(self) -> DataFrame:
        """(q_id, chunk_id, score): at most k rows a question and task; the k best are among them."""
        found = self._products(self.first)
        if self.first.all() or not len(self.ids):
            return found
        rows = self._kth(found).collect()  # one a question
        least = np.full(len(self.ids), -np.inf)
        for r in rows:
            least[np.searchsorted(self.ids, r["q_id"])] = r["least"]
        more = ~self.first & (self.bounds >= least[:, None])
        self.opened = self.first | more
        return found.unionByName(self._products(more)) if more.any() else found

    def share(self) -> float:
        """Of all pairs of questions and vectors, those whose product is worked out."""
        return float((self.opened * self.sizes).sum() / max(1, len(self.ids) * self.sizes.sum()))

    def _kth(self, found: DataFrame) -> DataFrame:
        w = Window.partitionBy("q_id").orderBy(F.desc("score"), "chunk_id")
        return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == self.k).select("q_id", F.col("score").alias("least"))

    def _products(self, mask: np.ndarray) -> DataFrame:
        wanted = {int(c): np.flatnonzero(mask[:, j]) for j, c in enumerate(self.cells) if mask[:, j].any()}
        ids, q, k = self.ids, self.q, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Best] = {}  # of the cells of this task
            for b in batches:
                at = b.column(2).to_numpy()
                edges = np.flatnonzero(np.diff(at, prepend=at[:1] - 1, append=at[-1:] + 1)) if len(at) else []
                for lo, hi in zip(edges[:-1], edges[1:]):  # runs of one cell
                    asked = wanted[int(at[lo])]
                    best = held.setdefault(int(at[lo]), Best(k))
                    for i in range(lo, hi, SLICE):
                        part = b.slice(i, min(SLICE, hi - i))
                        s = matrix(part.column(1)) @ q[asked].T
                        chunk = np.broadcast_to(part.column(0).to_numpy()[:, None], s.shape)
                        best.add([chunk, -s], [chunk, s])
            for cell, best in held.items():
                chunk, s = best.columns()
                who = np.broadcast_to(ids[wanted[cell]], s.shape)
                yield pa.RecordBatch.from_arrays([pa.array(who.ravel()), pa.array(chunk.ravel()), pa.array(s.ravel())], ["q_id", "chunk_id", "score"])

        rows = self.index.vectors
        rows = rows.filter(F.col("cell").isin(list(wanted))) if len(wanted) < len(self.cells) else rows
        return rows.select("chunk_id", "vector", "cell").mapInArrow(run, "q_id long, chunk_id long, score double")

"""Calls of outside models: each prompt once, spread over tasks, a few at a time, failures beside answers.

A model is a function of one or more strings, run inside tasks.  :class:`Loaded`
wraps one that is dear to load: a worker process loads it at its first call and
keeps it for later tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[..., str | None]
_KEPT: dict[str, Model] = {}


class Loaded:
    """A model made by ``load`` at the first call in each worker process."""

    def __init__(self, load: Callable[[], Model]):
        self.load, self.key = load, uuid.uuid4().hex

    def __call__(self, *prompt: str):
        if self.key not in _KEPT:
            _KEPT[self.key] = self.load()
        return _KEPT[self.key](*prompt)


def ask(rows: DataFrame, inputs: list[str], model: Model, where: Column | None = None, answer: str = "answer", parallel: int = 4, attempts: int = 2) -> DataFrame:
    """``rows`` with ``answer`` and ``error``: what ``model`` says to the columns ``inputs``.

    Equal inputs are brought together by a digest and asked once, however many rows
    have them.  A task keeps ``parallel`` calls under way; a call that raises is made
    again up to ``attempts`` times, then its answer is null and ``error`` says why.
    Rows that ``where`` leaves out are not asked and have neither.
    """
    digest = F.sha2(F.to_json(F.struct(*inputs)), 256)
    keyed = rows.withColumn("_asked", digest if where is None else F.when(where, digest))
    once = keyed.filter("_asked IS NOT NULL").groupBy("_asked").agg(*[F.first(c).alias(c) for c in inputs])

    def call(prompt: tuple) -> tuple[str | None, str | None]:
        for left in range(attempts - 1, -1, -1):
            try:
                return model(*prompt), None
            except Exception as e:  # noqa: BLE001  shown in the error column
                if not left:
                    return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(parallel) as pool:
            for b in batches:
                said = list(pool.map(call, zip(*(c.to_pylist() for c in b.columns[1:]))))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([s[k] for s in said], pa.string()) for k in (0, 1))], ["_asked", answer, "error"])

    # Calls are dear, so they go to all cores however few they are.
    spread = once.repartition(rows.sparkSession.sparkContext.defaultParallelism, "_asked")
    return keyed.join(spread.mapInArrow(run, f"_asked string, {answer} string, error string"), "_asked", "left").drop("_asked")

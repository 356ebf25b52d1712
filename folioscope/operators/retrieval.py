"""Retrieval and ranking for batches of questions.

Chunks are (chunk_id, text, region, ...), questions (q_id, question), vectors
(chunk_id, vector).  Questions travel to the chunks in blocks of at most about
``MOST_QUESTIONS``, however many there are, so no score needs a shuffle of chunk
texts; each task passes on its best chunks of every question alone.  Lexical
scores read the postings of a stored index (:mod:`.inverted`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import routing
from ..functions.lexicons import NO_PACK, REGION_ADJUSTMENT, DomainPack
from ..functions.text import TOKEN, tokens
from ..sources.store import new_folder
from .inverted import K1, B, InvertedIndex
from .topk import Best
from .vector_index import VectorIndex

MOST_QUESTIONS = 1_000
SEMANTIC, LEXICAL, KEYWORD = 0.55, 0.30, 0.15


def in_blocks(questions: DataFrame, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rank`` of all questions, block by block (dealt by a hash of q_id) if they are many."""
    n = questions.count()
    if n <= MOST_QUESTIONS:
        return rank(questions)
    blocks = -(-n * 5 // (4 * MOST_QUESTIONS))
    at = F.pmod(F.xxhash64("q_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [rank(questions.filter(at == i)) for i in range(blocks)])


#: Rows scored at a time: rows x questions numbers are held.
ROWS_AT_ONCE = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarities(vectors: DataFrame, queries: DataFrame, k: int | None = None, index: VectorIndex | None = None) -> DataFrame:
    """(q_id, chunk_id, score): inner products of all queries with all vectors.

    One matrix product per slice of vectors.  With ``k`` each task keeps the k
    best of every query as it goes and passes those on alone, and a window keeps
    the k best of them (ties to the smaller id): an exact top k that shuffles k
    rows per query and task.  With an ``index`` of the vectors, only cells that may
    hold one of the k best are read.
    """
    found = in_blocks(queries, lambda block: index.search(block, k).best() if index and k else _products(vectors, block, k))
    if k is None:
        return found
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _products(vectors: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    rows = queries.select("q_id", "vector").orderBy("q_id").collect()  # a block: bounded
    ids = np.array([r["q_id"] for r in rows], np.int64)
    q = np.array([r["vector"] for r in rows], np.float64)

    def batch(chunk: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        who = np.broadcast_to(ids, s.shape)
        return pa.RecordBatch.from_arrays([pa.array(who.ravel()), pa.array(chunk.ravel()), pa.array(s.ravel())], ["q_id", "chunk_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k or 0)
        for b in batches:
            for at in range(0, b.num_rows if len(ids) else 0, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                s = x @ q.T
                chunk = np.broadcast_to(part.column(0).to_numpy()[:, None], s.shape)
                if k is None:
                    yield batch(chunk, s)
                else:
                    best.add([chunk, -s], [chunk, s])
        if best.held is not None:
            yield batch(*best.columns())

    sound = vectors.filter(F.col("chunk_id").isNotNull() & F.col("vector").isNotNull())
    return sound.select(F.col("chunk_id").cast("long"), "vector").mapInArrow(run, "q_id long, chunk_id long, score double")


def dense_retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.15, index: VectorIndex | None = None) -> DataFrame:
    """The k best, then those at ``floor`` or above whose chunk exists; ranks keep their gaps."""
    top = similarities(vectors, queries, k, index).filter(F.col("score") >= floor)
    return top.join(chunks, "chunk_id").select("q_id", "rank", "score", *chunks.columns)


def semantic_scores(chunks: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_id, chunk_id, semantic): every chunk and question; chunks without a vector score 0."""
    return in_blocks(queries, lambda block: _semantic_block(chunks, vectors, block))


def _semantic_block(chunks: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    pairs = chunks.select("chunk_id").crossJoin(F.broadcast(queries.select("q_id")))
    return pairs.join(_products(vectors, queries, None), ["q_id", "chunk_id"], "left").select("q_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("semantic"))


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf)."""
    return chunks.select("chunk_id", F.explode_outer(tokens(F.col("text"))).alias("term")).filter("term IS NOT NULL").groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def indexed(chunks: DataFrame, index: InvertedIndex | None) -> InvertedIndex:
    """``index``, or one that is built for this call in the shared folder."""
    return index or InvertedIndex.build(chunks, new_folder(chunks.sparkSession, "postings"))


def bm25(chunks: DataFrame, questions: DataFrame, index: InvertedIndex | None = None) -> DataFrame:
    """(q_id, chunk_id, bm25) for pairs that share a term: Okapi with k1 1.5, b 0.75.

    Terms in over half of the chunks get epsilon times the mean idf of the
    vocabulary; repeated query tokens count each time.  Scores are read from the
    postings of ``index``; the asked terms and their weights travel to them.
    """
    return in_blocks(questions, indexed(chunks, index).bm25)


def bm25_top(chunks: DataFrame, questions: DataFrame, k: int = 10, index: InvertedIndex | None = None) -> DataFrame:
    """(q_id, rank, chunk_id, bm25): the k best by BM25; ranges of chunks that cannot hold one are not scored."""
    found = indexed(chunks, index)
    return in_blocks(questions, lambda block: found.best(block, k))


def keyword_overlap(chunks: DataFrame, questions: DataFrame, index: InvertedIndex | None = None) -> DataFrame:
    """(q_id, chunk_id, keyword) for pairs with a common token: share of the question's distinct tokens."""
    return in_blocks(questions, indexed(chunks, index).keyword)


def minmax(df: DataFrame, column: str, by: str = "q_id") -> DataFrame:
    """``column`` rescaled to [0, 1] within ``by``; all 0 if its range is below 1e-8."""
    ends = df.groupBy(by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") - F.col("_lo") < 1e-8, 0.0).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(ends, by).withColumn(column, scaled).drop("_lo", "_hi")


def hybrid_scores(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, pack: DomainPack = NO_PACK, index: InvertedIndex | None = None) -> DataFrame:
    """All seven scores and the intent of every question and chunk.

    ``questions`` is (q_id, question, vector).  Intent and objective read the
    raw question, BM25 and keywords the expanded one.  Blank questions go.
    """
    found = indexed(chunks, index)
    return in_blocks(questions, lambda block: _scored_block(chunks, vectors, block, pack, found))


def _scored_block(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, pack: DomainPack, index: InvertedIndex) -> DataFrame:
    asked = questions.filter(F.trim("question") != "").withColumn("expanded", routing.expand(F.col("question"), pack)).withColumn("intent", routing.intent(F.col("question"), pack))
    lexical = asked.select("q_id", F.col("expanded").alias("question"))
    on = ["q_id", "chunk_id"]
    df = semantic_scores(chunks, vectors, asked).join(index.bm25(lexical), on, "left").join(index.keyword(lexical), on, "left")
    df = df.select(*on, "semantic", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"))
    ends = df.groupBy("q_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("semantic", "bm25", "keyword") for n, f in (("lo", F.min), ("hi", F.max))])
    df = df.join(F.broadcast(ends), "q_id")
    for c in ("semantic", "bm25", "keyword"):
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        df = df.withColumn(f"{c}_score", F.when(hi - lo < 1e-8, 0.0).otherwise((F.col(c) - lo) / (hi - lo)))
    df = df.withColumn("hybrid_score", SEMANTIC * F.col("semantic_score") + LEXICAL * F.col("bm25_score") + KEYWORD * F.col("keyword_score"))
    df = df.join(F.broadcast(asked.select("q_id", "question", "intent")), "q_id").join(chunks, "chunk_id")
    df = df.withColumn("region_adjustment", routing.region_adjustment(F.col("region"), F.col("intent")))
    df = df.withColumn("objective_score", routing.objective_score(F.col("question"), F.col("text"), pack))
    return df.withColumn("final_score", F.col("hybrid_score") + F.col("region_adjustment") + F.col("objective_score"))


class _Batch:
    """The questions of a block as matrices, and all scores of some chunks for them."""

    def __init__(self, asked: list, weights: dict[str, float], mean_length: float):
        self.ids = np.array([r["q_id"] for r in asked], np.int64)
        self.vectors = np.array([r["vector"] for r in asked], np.float64)
        self.intent = [r["intent"] for r in asked]
        self.objective = np.array([float(r["objective"]) for r in asked])
        lists = [re.findall(TOKEN, r["expanded"].lower()) for r in asked]
        self.number = {t: i for i, t in enumerate(sorted({t for x in lists for t in x}))}
        self.idf, self.has = np.zeros((len(self.number), len(asked))), np.zeros((len(self.number), len(asked)))
        for q, x in enumerate(lists):
            for t in x:
                self.idf[self.number[t], q] += weights.get(t, 0.0)
                self.has[self.number[t], q] = 1
        self.has /= np.maximum(1, self.has.sum(axis=0))
        self.mean_length = mean_length

    def signals(self, vectors: pa.ListArray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Semantic, BM25 and keyword scores before scaling: chunks by questions.

        Posting i says that ``row[i]`` holds ``term[i]`` ``tf[i]`` times.
        """
        n = len(vectors)
        semantic = np.zeros((n, len(self.ids)))
        there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        if len(there):
            flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            semantic[there] = flat.reshape(len(there), -1) @ self.vectors.T
        factor, seen = np.zeros((n, len(self.number))), np.zeros((n, len(self.number)))
        factor[row, term] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean_length))
        seen[row, term] = 1
        return semantic, factor @ self.idf, seen @ self.has


def hybrid_search(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = 5, pack: DomainPack = NO_PACK, index: InvertedIndex | None = None) -> DataFrame:
    """The k best chunks of every question; ties go to the later chunk.

    The same scores as ``hybrid_scores`` without its pairs: postings of asked terms
    meet the vectors of neighbouring chunks, a first pass finds each signal's range of
    values, a second scales and adds up, and passes on the k best of these chunks.  No text is read but for the phrases that objective questions look
    for.  Final scores are compared at nine decimals, so the order does not hang on
    the order in which floating-point sums were made.
    """
    found = indexed(chunks, index)
    return in_blocks(questions, lambda block: _hybrid_block(chunks, vectors, block, k, pack, found))


def _hybrid_block(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, k: int, pack: DomainPack, index: InvertedIndex) -> DataFrame:
    asked = questions.filter(F.trim("question") != "").withColumn("expanded", routing.expand(F.col("question"), pack))
    asked = asked.select("q_id", "vector", "expanded", routing.intent(F.col("question"), pack).alias("intent"), routing.is_objective(F.col("question")).alias("objective")).orderBy("q_id").collect()
    spark = chunks.sparkSession
    scores = ("semantic_score", "bm25_score", "keyword_score", "hybrid_score", "region_adjustment", "objective_score", "final_score")
    numbered = sorted({t for r in asked for t in re.findall(TOKEN, r["expanded"].lower())})
    terms = F.broadcast(index.on_shelves(spark.createDataFrame(list(zip(numbered, range(len(numbered)))), "term string, number int")))
    weights = {r["term"]: r["idf"] for r in index.terms().join(terms, ["shelf", "term"]).select("term", "idf").collect()}  # of asked terms
    batch = _Batch(asked, weights, index.mean_length or 1.0)
    near = F.expr(f"chunk_id div {ROWS_AT_ONCE}").alias("near")  # chunks that are scored together
    held = index.postings().join(terms, ["shelf", "term"]).select(near, "chunk_id", "number", "tf", "len")
    objective = routing.objective_of(F.col("text"), pack) if batch.objective.any() else F.lit(0.0)
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "region", objective.alias("objective")).filter("chunk_id IS NOT NULL")
    rows = rows.join(vectors.select("chunk_id", "vector"), "chunk_id", "left").withColumn("near", near)
    met = rows.groupBy("near").cogroup(held.groupBy("near"))

    def parts(own: pa.Table, postings: pa.Table) -> Iterator[tuple]:
        """Slices of neighbouring chunks with their signals."""
        if not own.num_rows or not asked:
            return
        own = own.sort_by("chunk_id").combine_chunks()
        ids = own["chunk_id"].to_numpy()
        number, tf, length = (postings[c].to_numpy() for c in ("number", "tf", "len"))
        row = np.searchsorted(ids, postings["chunk_id"].to_numpy())
        order = np.argsort(row, kind="stable")
        row, number, tf, length = row[order], number[order], tf[order].astype(np.float64), length[order]
        for at in range(0, len(ids), ROWS_AT_ONCE):
            b = own.slice(at, ROWS_AT_ONCE)
            i, j = np.searchsorted(row, [at, at + ROWS_AT_ONCE])
            yield b, batch.signals(b["vector"].combine_chunks(), row[i:j] - at, number[i:j], tf[i:j], length[i:j])

    def ranges(own: pa.Table, postings: pa.Table) -> pa.Table:
        low = high = np.zeros((3, 0))
        for _, signals in parts(own, postings):
            lo, hi = (np.stack([f(s, axis=0) for s in signals]) for f in (np.min, np.max))
            low, high = (lo, hi) if not low.size else (np.minimum(low, lo), np.maximum(high, hi))
        q = low.shape[1]
        return pa.table([np.repeat(np.arange(3), q), np.tile(np.arange(q), 3), low.ravel(), high.ravel()], ["s", "q", "lo", "hi"])

    ends = np.zeros((2, 3, max(1, len(asked))))
    for r in met.applyInArrow(ranges, "s long, q long, lo double, hi double").groupBy("s", "q").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect() if asked else []:
        ends[:, r["s"], r["q"]] = r["lo"], r["hi"]
    names = ["q_id", "chunk_id", "intent", *scores]
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * len(scores)]

    def best(own: pa.Table, postings: pa.Table) -> pa.Table:
        top = Best(k)
        for b, signals in parts(own, postings):
            span = ends[1] - ends[0]
            sem, lex, key = (np.where(span[i] < 1e-8, 0.0, (x - ends[0, i]) / np.where(span[i] < 1e-8, 1.0, span[i])) for i, x in enumerate(signals))
            hybrid = SEMANTIC * sem + LEXICAL * lex + KEYWORD * key
            region = np.array([[REGION_ADJUSTMENT.get((i, r), 0.0) for i in batch.intent] for r in b["region"].to_pylist()])
            objective = b["objective"].to_numpy()[:, None] * batch.objective
            final = hybrid + region + objective
            chunk = np.broadcast_to(b["chunk_id"].to_numpy()[:, None], final.shape)
            top.add([-chunk, -np.round(final, 9)], [chunk, sem, lex, key, hybrid, region, objective, final])
        if top.held is None:
            return pa.table([pa.array([], t) for t in kinds], names)
        chunk, *found = top.columns()
        who = np.broadcast_to(np.arange(chunk.shape[1]), chunk.shape).ravel()
        return pa.table([pa.array(batch.ids[who]), pa.array(chunk.ravel()), pa.array([batch.intent[x] for x in who]), *(pa.array(x.ravel()) for x in found)], names)

    found = met.applyInArrow(best, f"q_id long, chunk_id long, intent string, {', '.join(f'{c} double' for c in scores)}")
    w = Window.partitionBy("q_id").orderBy(F.desc(F.round("final_score", 9)), F.desc("chunk_id"))
    top = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    rest = [c for c in chunks.columns if c != "chunk_id"]
    return chunks.join(F.broadcast(top), "chunk_id").select("q_id", "rank", "chunk_id", "intent", *scores, *rest)  # k rows a question

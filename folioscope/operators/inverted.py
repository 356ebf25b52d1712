"""A stored inverted index: postings written once at ingest, read by every lexical score.

Three Parquet tables and a row of facts lie below one path:

``postings``  (term, range, chunk_id, tf, len): how often a term stands in a chunk of
              ``len`` tokens; a range is ``WIDTH`` neighbouring chunk ids
``blocks``    (term, range, most, n): for a term's postings of one range their number
              and the greatest factor that BM25 gives any of them
``terms``     (term, df, idf): the weight that BM25 gives a term
``facts``     chunks, their mean length, and the sizes the index was built with

All but the facts are partitioned by ``shelf``, a hash of the term, and sorted by
term, so a read for some terms skips the row groups of others.  A term that stands
in very many chunks is written by several tasks, each for its own ranges.

Edge cases: null and empty texts are chunks of no tokens, which count for the mean
length; chunks without an id cannot be found and are left out; an empty table gives
an index in which nothing is found; terms that no chunk holds weigh nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TOKEN, tokens
from ..sources.store import written
from .topk import Best

#: Okapi BM25; terms in over half of the chunks weigh EPSILON times the mean weight.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunk ids of a range, and files (or more) that hold the postings.
WIDTH, SHELVES = 4_096, 16
#: Chunks whose terms are counted together, or fewer if they hold this many tokens; postings of an Arrow batch.
CHUNKS_AT_ONCE, TOKENS_AT_ONCE, ROWS_OUT = 4_096, 500_000, 50_000
#: Neighbouring chunks that are scored together.
NEAR = 512
#: Ranges that may travel to the postings; more meet them by a shuffle.
MOST_SENT = 1_000_000
#: Ranges that share a task when postings are written.
RANGES_A_TASK = 16

FACTS = "n_chunks long, mean_length double, n_ranges long, width int, shelves int"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, chunk_id, tf, len) of chunks of lower-case text: a chunk's terms are
    counted where it is, so that its postings are shuffled once, to their shelf.

    Chunks are counted together up to some number of tokens, and their postings leave
    in the order of terms: what is shuffled compresses well and is sorted in runs.
    """
    find = re.compile(TOKEN, re.ASCII).findall
    ids, sizes, held = [], [], []

    def flush() -> Iterator[pa.RecordBatch]:
        terms = pa.array(held, pa.string()).dictionary_encode()
        order = pc.array_sort_indices(terms.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        size = np.array(sizes, np.int64)
        key = place[terms.indices.to_numpy()] * len(ids) + np.repeat(np.arange(len(ids)), size)
        key, tf = np.unique(key, return_counts=True)
        term, chunk = np.divmod(key, len(ids))
        columns = [terms.dictionary.take(pa.array(order[term])), pa.array(np.array(ids, np.int64)[chunk]), pa.array(tf.astype(np.int32)), pa.array(size[chunk].astype(np.int32))]
        out = pa.RecordBatch.from_arrays(columns, ["term", "chunk_id", "tf", "len"])
        for at in range(0, out.num_rows, ROWS_OUT):
            yield out.slice(at, ROWS_OUT)
        for x in (ids, sizes, held):
            x.clear()

    for b in batches:
        for chunk, text in zip(b.column(0).to_pylist(), b.column(1)):
            found = find(text.as_py())
            if found:
                ids.append(chunk)
                sizes.append(len(found))
                held.extend(found)
            if len(ids) >= CHUNKS_AT_ONCE or len(held) >= TOKENS_AT_ONCE:
                yield from flush()
    if held:
        yield from flush()


def asked_terms(questions: DataFrame) -> DataFrame:
    """(q_id, term, times) of (q_id, question)."""
    rows = questions.select("q_id", F.explode_outer(tokens(F.col("question"))).alias("term")).filter("term IS NOT NULL")
    return rows.groupBy("q_id", "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass
class InvertedIndex:
    """An index at ``path``; its tables are read as they are asked for.

    Methods take a block of questions at a time (``retrieval.in_blocks``), whose
    terms travel to the postings.
    """

    spark: SparkSession
    path: str
    n_chunks: int
    mean_length: float
    n_ranges: int
    width: int
    shelves: int
    tables: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> InvertedIndex:
        return cls(spark, path, **spark.read.schema(FACTS).parquet(f"{path}/facts").first().asDict())

    @classmethod
    def build(cls, chunks: DataFrame, path: str, width: int = WIDTH, shelves: int = SHELVES) -> InvertedIndex:
        """Write the index of (chunk_id, text); the facts come last, so an index without them is not whole."""
        spark, have = chunks.sparkSession, chunks.filter("chunk_id IS NOT NULL")
        shelf = F.pmod(F.xxhash64("term"), F.lit(shelves)).cast("int").alias("shelf")
        made = cls(spark, path, have.count(), 0.0, 0, width, shelves)
        held = have.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
        rows = held.mapInArrow(_counted, "term string, chunk_id long, tf int, len int").select("term", F.expr(f"chunk_id div {width}").alias("range"), "chunk_id", "tf", "len", shelf)
        made._write(rows, "postings", "term", "chunk_id")
        made.mean_length = (made.postings().agg(F.sum("tf")).first()[0] or 0) / max(1, made.n_chunks)
        blocks = made.postings().groupBy("shelf", "term", "range").agg(F.max(made.factor()).alias("most"), F.count(F.lit(1)).alias("n"))
        made._write(blocks, "blocks", "term", "range")
        made.n_ranges = made.blocks().select("range").distinct().count()
        df = made.blocks().groupBy("shelf", "term").agg(F.sum("n").alias("df"))
        raw = F.log(F.lit(made.n_chunks) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = df.agg(F.avg(raw)).first()[0] or 0.0
        weights = df.withColumn("idf", F.when(raw < 0, F.lit(EPSILON * mean)).otherwise(raw))
        made._write(weights, "terms", "term", dealt=False)
        spark.createDataFrame([(made.n_chunks, made.mean_length, made.n_ranges, width, shelves)], FACTS).write.mode("overwrite").parquet(f"{path}/facts")
        return made

    def _write(self, df: DataFrame, name: str, *order: str, dealt: bool = True) -> None:
        """Write a table by shelves; ``dealt`` gives each shelf and ``RANGES_A_TASK`` ranges a task of
        their own, so a task holds no more however many chunks there are."""
        if dealt:
            groups = max(1, -(-self.n_chunks // (self.width * RANGES_A_TASK)))
            df = df.repartitionById(self.shelves * groups, (F.col("shelf") * groups + F.pmod(F.expr(f"range div {RANGES_A_TASK}"), F.lit(groups))).cast("int"))
        df.sortWithinPartitions("shelf", *order).write.mode("overwrite").partitionBy("shelf").parquet(f"{self.path}/{name}")

    def postings(self) -> DataFrame:
        return self._read("postings", "term string, range long, chunk_id long, tf int, len int, shelf int")

    def blocks(self) -> DataFrame:
        return self._read("blocks", "term string, range long, most double, n long, shelf int")

    def terms(self) -> DataFrame:
        return self._read("terms", "term string, df long, idf double, shelf int")

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table; its files are listed once."""
        if name not in self.tables:
            self.tables[name] = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.tables[name]

    def factor(self) -> Column:
        """What BM25 multiplies a term's weight by in a chunk."""
        tf = F.col("tf")
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(self.mean_length or 1.0)))

    def on_shelves(self, asked: DataFrame) -> DataFrame:
        """``asked`` with the shelf of its term, for joins that prune partitions."""
        return asked.withColumn("shelf", F.pmod(F.xxhash64("term"), F.lit(self.shelves)).cast("int"))

    def weighed(self, questions: DataFrame) -> DataFrame:
        """(q_id, term, shelf, times, weight) of the terms of (q_id, question) that some chunk holds."""
        asked = self.on_shelves(asked_terms(questions))
        met = self.terms().join(F.broadcast(asked), ["shelf", "term"])  # a block of questions: bounded
        return met.select("q_id", "term", "shelf", "times", (F.col("times") * F.col("idf")).alias("weight"))

    def bm25(self, questions: DataFrame) -> DataFrame:
        """(q_id, chunk_id, bm25) of all pairs that share a term."""
        met = self.postings().join(F.broadcast(self.weighed(questions)), ["shelf", "term"])
        return met.groupBy("q_id", "chunk_id").agg(F.sum(F.col("weight") * self.factor()).alias("bm25"))

    def keyword(self, questions: DataFrame) -> DataFrame:
        """(q_id, chunk_id, keyword) of all pairs that share a term: share of the question's distinct terms.

        Pairs are counted where the postings of neighbouring chunks meet, and never shuffled.
        """
        asked = asked_terms(questions.filter("q_id IS NOT NULL")).collect()  # a block of questions: bounded
        if not asked:
            return self.spark.createDataFrame([], "q_id long, chunk_id long, keyword double")
        ids, terms = sorted({r["q_id"] for r in asked}), sorted({r["term"] for r in asked})
        who, place = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
        of_term, of_question = (np.array(x, np.int64) for x in zip(*sorted((place[r["term"]], who[r["q_id"]]) for r in asked)))
        q_ids, size = np.array(ids, np.int64), np.bincount(of_question)

        def run(own: pa.Table) -> pa.Table:
            chunks, row = np.unique(own["chunk_id"].to_numpy(), return_inverse=True)
            there, column = np.unique(own["number"].to_numpy(), return_inverse=True)  # terms of this neighbourhood
            at = np.searchsorted(there, of_term)
            known = (at < len(there)) & (there[np.minimum(at, len(there) - 1)] == of_term)
            has, seen = np.zeros((len(there), len(q_ids))), np.zeros((len(chunks), len(there)))
            has[at[known], of_question[known]], seen[row, column] = 1, 1
            shared = seen @ has
            chunk, q = np.nonzero(shared)
            return pa.table([q_ids[q], chunks[chunk], shared[chunk, q] / size[q]], ["q_id", "chunk_id", "keyword"])

        return self._near(terms).select("near", "chunk_id", "number").groupBy("near").applyInArrow(run, "q_id long, chunk_id long, keyword double")

    def _near(self, terms: list[str], ranges: DataFrame | None = None) -> DataFrame:
        """(near, chunk_id, number, tf, len): postings of ``terms``, by their places in the list, with
        the neighbourhood of their chunk; with ``ranges`` those of chunks of these alone."""
        numbered = self.on_shelves(self.spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, number int"))
        rows = self.postings().join(F.broadcast(numbered), ["shelf", "term"])  # terms of a block
        if ranges is not None:
            rows = rows.join(F.broadcast(ranges) if ranges.count() <= MOST_SENT else ranges, "range")
        return rows.select(F.expr(f"chunk_id div {NEAR}").alias("near"), "chunk_id", "number", "tf", "len")

    # ------------------------------------------------------------------ best chunks

    def bounds(self, weighed: DataFrame) -> DataFrame:
        """(q_id, range, bound): no chunk of the range scores higher."""
        part = F.greatest(F.col("weight"), F.lit(0.0)) * F.col("most")
        return self.blocks().join(F.broadcast(weighed), ["shelf", "term"]).groupBy("q_id", "range").agg(F.sum(part).alias("bound"))

    def _best_near(self, asked: list, k: int, ranges: DataFrame | None = None) -> DataFrame:
        """(q_id, chunk_id, bm25): of every ``NEAR`` neighbouring chunks the k best for each question.

        ``asked`` are the rows of :meth:`weighed`.  Postings of asked terms are shuffled
        to their neighbourhood, where scores are one matrix product, so pairs of questions
        and chunks never leave it.  With ``ranges`` only chunks of these are scored.
        """
        ids, terms = sorted({r["q_id"] for r in asked}), sorted({r["term"] for r in asked})
        who, place = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
        pairs = sorted((place[r["term"]], who[r["q_id"]], r["weight"]) for r in asked)  # one a question and term
        of_term, of_question, weights = (np.array([p[k] for p in pairs], kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        q_ids, mean = np.array(ids, np.int64), self.mean_length or 1.0

        def run(own: pa.Table) -> pa.Table:
            chunks, row = np.unique(own["chunk_id"].to_numpy(), return_inverse=True)
            there, column = np.unique(own["number"].to_numpy(), return_inverse=True)  # terms of this neighbourhood
            at = np.searchsorted(there, of_term)
            known = (at < len(there)) & (there[np.minimum(at, len(there) - 1)] == of_term)
            weight, has = np.zeros((len(there), len(q_ids))), np.zeros((len(there), len(q_ids)))
            weight[at[known], of_question[known]], has[at[known], of_question[known]] = weights[known], 1
            tf, length = own["tf"].to_numpy().astype(np.float64), own["len"].to_numpy()
            factor, seen = np.zeros((len(chunks), len(there))), np.zeros((len(chunks), len(there)))
            factor[row, column], seen[row, column] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)), 1
            score = np.where(seen @ has > 0, factor @ weight, -np.inf)
            best, chunk = Best(k), np.broadcast_to(chunks[:, None], score.shape)
            best.add([chunk, -np.round(score, 6)], [chunk, score])
            chunk, score = best.columns()
            met = score > -np.inf
            return pa.table([np.broadcast_to(q_ids, score.shape)[met], chunk[met], score[met]], ["q_id", "chunk_id", "bm25"])

        return self._near(terms, ranges).groupBy("near").applyInArrow(run, "q_id long, chunk_id long, bm25 double")

    def best(self, questions: DataFrame, k: int, probe: int = 4) -> DataFrame:
        """(q_id, rank, chunk_id, bm25): the k best chunks of every question, exactly.

        Scores are compared at six decimals, ties go to the smaller id.  The
        ``probe`` ranges of the highest bounds of each question are scored first; its
        k-th best score there is one that the k-th best of all reaches, so of the other
        ranges only those whose bound reaches it, for any question, are opened.
        """
        order = Window.partitionBy("q_id").orderBy(F.desc("bm25"), "chunk_id")
        asked = self.weighed(questions).collect()  # a block of questions: bounded
        if not asked:
            return self.spark.createDataFrame([], "q_id long, rank int, chunk_id long, bm25 double")
        if self.n_ranges <= probe:
            found = self._best_near(asked, k)
        else:
            _, scored, rest = self.opened(asked, k, probe)
            found = scored.unionByName(self._best_near(asked, k, rest.select("range").distinct()))
        ranked = found.withColumn("bm25", F.round("bm25", 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.select("q_id", "rank", "chunk_id", "bm25")

    def opened(self, asked: list, k: int, probe: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The ranges (q_id, range) that are scored first, the best scores there, and the ranges
        that may hold one of the k best beside them.  Bounds and first scores are written,
        as each is read twice."""
        by_bound = Window.partitionBy("q_id").orderBy(F.desc("bound"), "range")
        weighed = self.spark.createDataFrame(asked, "q_id long, term string, shelf int, times long, weight double")
        bounds = written(self.bounds(weighed), "bounds")
        first = bounds.withColumn("_r", F.row_number().over(by_bound)).filter(F.col("_r") <= probe).select("q_id", "range")
        tried = written(first.select("range").distinct(), "tried")
        scored = written(self._best_near(asked, k, tried), "scored")
        kth = scored.withColumn("_r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("bm25")))).filter(F.col("_r") == k)
        others = bounds.join(F.broadcast(tried), "range", "left_anti") if tried.count() <= MOST_SENT else bounds.join(tried, "range", "left_anti")
        others = others.join(kth.select("q_id", F.col("bm25").alias("_least")), "q_id", "left")
        # Rounding may lift a score by half of the last decimal.
        rest = others.filter(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - 2e-6)).select("q_id", "range")
        return first, scored, rest

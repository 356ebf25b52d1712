"""How quality filters interact: a packed bitmap index over documents.

A map task judges whole texts once and keeps a row of a few bytes for each
document: its part, its failures as bits, and a digest of its text.  Which copy
of a text comes first is an aggregation over digests and a join on (id, digest),
keys that no group of copies crowds.

The index holds, for blocks of rows of a partition, one NumPy bitset for each
filter and each label.  Rows are sorted by part and every part starts at a whole
byte, so a part's bitset is a byte range of a block, and the AND with it a slice;
bytes are padded with bits that no document owns.  For each of the 32 subsets of
filters, which are the prefixes of all orders, the surviving rows are the AND-NOT
of its bitsets; bytes are popcounted and added up by part.  Partitions send 32
counts of documents, good and toxic ones for each of their parts; these are summed,
and every step of every order is a difference of two of them.

Edge cases: a null text is an empty one, a null language an empty part; equal
texts of one id are copies of none of each other (no id is smaller); a row without
an id has no place in the order: it neither fails E nor makes others fail; repeated
labels of a document count once, as good or toxic if any says so, null labels as
neither; very long texts are judged whole; further columns, also of names used
here, are not read; an empty table has no part and so an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, trimmed

FILTERS = "ABCDE"
#: Kinds of rows that are counted: all, good, toxic.
KINDS = 3
SUBSETS = 1 << len(FILTERS)

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"

#: Rows of a block of the index.
BLOCK_ROWS = 1 << 16
#: Parts whose counts a task holds before it passes them on.
MOST_PARTS = 10_000


def failures(text: bytes) -> int:
    """Bits 0 to 3: whether a UTF-8 text fails A, B, C, D."""
    words = text.split()  # at ASCII white space, the only kind that bytes know
    n = len(words)
    found = n < 200
    found |= (100 * len(set(words)) < 50 * n) << 1
    found |= (100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * len(text.translate(None, _CONTINUATION))) << 2
    found |= (len(text.translate(None, _MARKS)) < len(text)) << 3
    return found


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails) of every document; its text is read once and not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(2)]
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digests, pa.array([failures(t) for t in texts], pa.int8())], ["doc_id", "part", "digest", "fails"])

    ship(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, part string, digest binary, fails byte")


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with bit 4 of ``fails`` where a smaller id has the same digest.

    Only the first row of a digest finds itself among the firsts, so the join's
    keys are as many as the rows, however large a group of copies is.
    """
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("_id"))
    first = first.filter("_id IS NOT NULL").select("_id", F.col("digest").alias("_digest"), F.lit(True).alias("_first"))
    met = rows.join(first, (rows["doc_id"] == first["_id"]) & (rows["digest"] == first["_digest"]), "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return met.select("doc_id", "part", (F.col("fails") + F.when(copy, 1 << 4).otherwise(0)).cast("byte").alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` as (part, fails, marks): bit 0 for good, bit 1 for toxic documents."""
    one = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    mark = one.agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    bit = lambda c, n: F.when(F.col(c), n).otherwise(0)
    met = rows.join(mark, rows["doc_id"] == mark["_id"], "left")
    return met.select("part", "fails", (bit("_good", 1) + bit("_toxic", 2)).cast("byte").alias("marks"))


class Bitmap:
    """Packed bitsets of a block: present rows, filters and labels, with the byte at which each part starts."""

    def __init__(self, parts: np.ndarray, fails: np.ndarray, marks: np.ndarray):
        """``parts`` are the rows' part numbers from 0, each of which occurs."""
        order = np.argsort(parts, kind="stable")
        sizes = np.bincount(parts)
        widths = -(-sizes // 8)  # bytes of each part
        self.starts = np.concatenate([[0], np.cumsum(widths)[:-1]])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(len(parts)) - np.repeat(first, sizes) + np.repeat(self.starts * 8, sizes)
        n = int(widths.sum()) * 8
        fails, marks = fails[order], marks[order]

        def packed(bits: np.ndarray) -> np.ndarray:
            whole = np.zeros(n, bool)
            whole[place] = bits
            return np.packbits(whole)

        self.present = packed(np.ones(len(parts), bool))
        self.filters = [packed(fails >> k & 1) for k in range(len(FILTERS))]
        self.labels = [self.present, packed(marks & 1), packed(marks >> 1 & 1)]

    def survivors(self) -> np.ndarray:
        """Counts of parts x subsets x kinds: rows of the part and kind that fail no filter of the subset."""
        out = np.zeros((len(self.starts), SUBSETS, KINDS), np.int64)
        left = {0: self.present}
        for s in range(SUBSETS):
            if s:
                k = s.bit_length() - 1
                left[s] = left[s ^ 1 << k] & ~self.filters[k]
            for j, kind in enumerate(self.labels):
                out[:, s, j] = np.add.reduceat(np.bitwise_count(left[s] & kind), self.starts, dtype=np.int64)
        return out


def survivor_counts(rows: DataFrame) -> DataFrame:
    """(part, counts): for subset s and kind k the documents at s * 3 + k, summed over all partitions."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                held.append(b.slice(at, BLOCK_ROWS))
                n += held[-1].num_rows
                if n >= BLOCK_ROWS:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def batch(found: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([c.ravel() for c in found.values()], pa.list_(pa.int64()))], ["part", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for t in blocks(batches):
            coded = t.column(0).combine_chunks().dictionary_encode()
            index = Bitmap(coded.indices.to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy())
            for part, counts in zip(coded.dictionary.to_pylist(), index.survivors()):
                found[part] = found[part] + counts if part in found else counts
            if len(found) > MOST_PARTS:
                yield batch(found)
                found = {}
        if found:
            yield batch(found)

    sent = rows.select("part", "fails", "marks").mapInArrow(trimmed(run), "part string, counts array<long>")
    summed = sent.select("part", F.posexplode("counts").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    return summed.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("counts"))  # 96 a part


def steps(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    every = SUBSETS - 1
    names, numbers, own, before = [], [], [], []
    for o in orders:
        done = 0
        for k, f in enumerate(o):
            names.append(o)
            numbers.append(k + 1)
            own.append(bit[f])
            before.append(done)
            done |= bit[f]
    literal = lambda x, kind="int": F.split(F.lit(",".join(map(str, x))), ",").cast(f"array<{kind}>")  # noqa: E731  folded to one constant
    at = lambda x, kind="int": F.element_at(literal(x, kind), F.col("i") + 1)
    left = lambda subset, kind=0: F.element_at("counts", (subset * KINDS + kind + 1).cast("int"))

    def shapley(f: str) -> Column:
        """What filter ``f`` removes, summed over all orders: how often each prefix stands before it."""
        total = F.lit(0).cast("long")
        for s in range(SUBSETS):
            if not s & bit[f]:
                n = s.bit_count()
                total = total + factorial(n) * factorial(len(FILTERS) - 1 - n) * (left(F.lit(s)) - left(F.lit(s | bit[f])))
        return total

    rows = counts.withColumn("_shapley", F.array(*map(shapley, FILTERS)))
    rows = rows.select("part", "counts", "_shapley", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("i"))
    rows = rows.select("part", "counts", "_shapley", at(names, "string").alias("filter_order"), at(numbers).alias("step"), at(own).alias("f"), at(before).alias("s"))
    after, alone, rest = F.col("s") + F.col("f"), F.col("f"), F.lit(every) - F.col("f")
    removed = left(F.col("s")) - left(after)
    return rows.select(
        "part",
        "filter_order",
        "step",
        left(after).alias("kept"),
        removed.alias("removed"),
        (left(F.lit(0)) - left(alone) - removed).alias("redundant"),
        (left(rest) - left(F.lit(every))).alias("unique_fails"),
        (left(F.col("s"), 1) - left(after, 1)).alias("good_lost"),
        (left(F.col("s"), 2) - left(after, 2)).alias("toxic_lost"),
        F.element_at("_shapley", F.array_position(literal([bit[f] for f in FILTERS]), F.col("f")).cast("int")).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of every order of the five filters, for each part.

    ``documents`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic.
    """
    rows = materialize(judged(documents), "audit-rows")  # read twice: for the firsts and to meet them
    return steps(survivor_counts(with_labels(with_copies(rows), labels)))

"""Document fingerprints by context-triggered piecewise hashing.

*Boundaries.*  A rolling hash of the last eight bytes of the UTF-8 text is taken at
every byte.  At block size 2**k a chunk ends where its low k bits are all ones, so
the boundaries of a size are among those of the next smaller one, and an edit moves
only the boundaries near it.

*Signature.*  A chunk's character is six bits of the sum of the (mixed) rolling
hashes inside it; of a run of one character three stay, so that repeated lines do
not crowd out the rest.  The block size follows from the length (24 to 48 chunks on
average), or is the next one at which the signature has at most 64 characters; a
text of at most 48 bytes has chunks of one byte.  The fingerprint of a whole text
of any length is ``k:signature:signature at the next size``.

*Comparison.*  Signatures of equal size are compared: both pairs if the sizes are
the same (the greater likeness counts), one if they are neighbours, none further
apart.  Likeness is one minus the edit distance by the longer length.  Signatures
that share no run of four characters (three quarters of the shorter one, if that is
less) are held to be unrelated: 0.  Equal fingerprints have likeness 1.
Edit distances of a batch of pairs are worked out together, 64 rows of the
distance table in the bits of a word.

``edited_neighbours`` deals documents to ranges of their ids (rows of one id by a
hash of their text), which shuffles every text once; within a range a document
meets the next one as it streams by.  The last document of a range meets the first
one of the next from a small table of two rows a range.

Edge cases: a null text is an empty one; an empty text has the fingerprint ``0::``,
which is like itself alone; very long texts are read in slices of fixed size; equal
texts have equal fingerprints; documents of one id are in the order of a hash of
their texts, rows without an id come first; a table of one row is its own next
document; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, trimmed

#: Bytes that the rolling hash looks at, chunks of a text on average at most, characters of a signature.
CONTEXT, CHUNKS, LONGEST = 8, 48, 64
#: The run of characters that related signatures share.
RUN = 4
#: Bytes hashed at a time.
SLICE = 1 << 18

_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_FACTOR, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Block sizes are 2**0 to 2**32; beyond them lies one without boundaries.
_UNBOUND = 33


def _rolling(data: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The hash of the eight bytes up to each byte of ``data``; ``context`` are the bytes before it."""
    h = np.concatenate([context, data]).astype(np.uint32) + np.uint32(1)
    factor = _FACTOR
    for step in (1, 2, 4):  # windows of 2, 4, 8 bytes
        h[step:] += h[:-step] * factor
        factor = factor * factor
    h = h[len(context) :]
    h ^= h >> np.uint32(15)
    h *= _MIX
    h ^= h >> np.uint32(13)
    return h


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """Rolling hashes of a text, slice by slice; before the text stand zeros."""
    for at in range(0, len(data), SLICE):
        context = data[max(0, at - CONTEXT + 1) : at] if at else np.zeros(CONTEXT - 1, np.uint8)
        yield _rolling(data[at : at + SLICE], context)


def _chunks(hashes: Iterable[np.ndarray], k: int) -> Iterator[np.ndarray]:
    """Characters of the chunks at block size 2**k, as slices complete them."""
    ones, carried = np.uint32((1 << min(k, 32)) - 1), None
    letter = lambda sums: _LETTERS[(sums * _MIX) >> np.uint32(26)]
    for h in hashes:
        ends = np.flatnonzero((h & ones) == ones) + 1 if k < _UNBOUND else np.zeros(0, np.int64)
        whole = len(ends) > 0 and ends[-1] == len(h)
        sums = np.add.reduceat((h ^ h >> np.uint32(7)) * _FACTOR, np.concatenate([[0], ends[: len(ends) - whole]]), dtype=np.uint32)
        if carried is not None:
            sums[0] += carried
        carried = None if whole else sums[-1]
        yield letter(sums[: len(ends)])
    if carried is not None:
        yield letter(np.array([carried], np.uint32))


def signature(hashes: Iterable[np.ndarray], k: int) -> str | None:
    """A character for each chunk, of runs of one character the first three; None if they are over 64."""
    out, tail = "", np.zeros(3, np.uint8)
    with np.errstate(over="ignore"):
        for found in _chunks(hashes, k):
            letters = np.concatenate([tail, found])
            same = letters[1:] == letters[:-1]
            out += found[~(same[2:] & same[1:-1] & same[:-2])].tobytes().decode()
            tail = letters[-3:]
            if len(out) > LONGEST:
                return None
    return out


def fingerprint(text: bytes) -> str:
    """``k:signature:coarser signature`` of a UTF-8 text."""
    data = np.frombuffer(text, np.uint8)
    with np.errstate(over="ignore"):
        kept = list(_slices(data)) if len(data) <= SLICE else None
        at = lambda k: signature(kept if kept is not None else _slices(data), k)
        k = max(0, -(-len(data) // CHUNKS) - 1).bit_length()
        fine, coarse = at(k), at(k + 1)
        while fine is None or coarse is None:  # at the last size there is one chunk
            k, fine, coarse = k + 1, coarse, at(k + 2)
        return f"{k}:{fine}:{coarse}"


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers, rows x 64 (filled up with 0), and lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(w.ljust(64, "\0") for w in words).encode(), np.uint8).reshape(len(words), 64)
    return flat, lengths


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of words of at most 64 ASCII characters.

    A column of each pair's distance table is held as the bits of two words, its
    steps up and down, and all pairs go on to the next column together.
    """
    one, full = np.uint64(1), ~np.uint64(0)
    x, m = _codes(a)
    y, n = _codes(b)
    rows = np.arange(len(a))
    where = np.zeros((len(a), 128), np.uint64)
    for i in range(64):
        here = i < m
        where[rows[here], x[here, i]] |= one << np.uint64(i)
    up, down = np.full(len(a), full), np.zeros(len(a), np.uint64)
    top = one << np.maximum(m - 1, 0).astype(np.uint64)
    distance = m.copy()
    with np.errstate(over="ignore"):
        for j in range(int(n.max(initial=0))):
            on = j < n
            same = where[rows, y[:, j]]
            vertical = same | down
            horizontal = (((same & up) + up) ^ up) | same
            plus, minus = down | ~(horizontal | up), up & horizontal
            distance += on * ((plus & top != 0).astype(np.int64) - (minus & top != 0))
            plus, minus = plus << one | one, minus << one
            up, down = np.where(on, minus | ~(vertical | plus), up), np.where(on, plus & vertical, down)
    return np.where(m == 0, n, distance)


def _related(a: str, b: str) -> bool:
    """Whether the signatures share a run that chance does not give."""
    run = max(1, min(RUN, 3 * min(len(a), len(b)) // 4))
    return not {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint({b[i : i + run] for i in range(len(b) - run + 1)})


def likenesses(pairs: list[tuple[str, str]]) -> list[float]:
    """Likeness of pairs of fingerprints, 0 to 1."""
    out = [float(a == b) for a, b in pairs]
    at, left, right = [], [], []
    for i, (f, g) in enumerate(pairs):
        if f == g:
            continue
        j, a, a2 = f.split(":")
        k, b, b2 = g.split(":")
        d = int(j) - int(k)
        for s, t in [(a, b), (a2, b2)] if d == 0 else [(a, b2)] if d == 1 else [(a2, b)] if d == -1 else []:
            if s and t and _related(s, t):
                at.append(i)
                left.append(s)
                right.append(t)
    if at:
        longer = np.array([max(len(s), len(t)) for s, t in zip(left, right)])
        for i, score in zip(at, (1 - edit_distances(left, right) / longer).tolist()):
            out[i] = max(out[i], score)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


#: What is known of a document beside the next one.
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def _compared(met: list[tuple[int | None, str, str, str, str]]) -> list[list]:
    """Columns of ``FIELDS`` of documents given as (id, text, fingerprint, next text, next fingerprint)."""
    changed = [edited(text, after).encode() for _, text, _, after, _ in met]
    own, other = [m[2] for m in met], [fingerprint(c) for c in changed]
    scores = likenesses([*zip(own, other), *((m[2], m[4]) for m in met)])
    return [[m[0] for m in met], [len(m[1]) for m in met], [hashlib.sha256(c).hexdigest() for c in changed], own, other, scores[: len(met)], scores[len(met) :]]


def _batch(columns: list[list], edges: list[tuple[int | None, str | None]]) -> pa.RecordBatch:
    n = len(columns[0]) if columns else 0
    blank = [None] * len(edges)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = columns or [[]] * len(kinds)
    arrays = [pa.array([*c, *blank], t) for c, t in zip(columns, kinds)]
    place = [pa.array([None] * n + [e[k] for e in edges], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays([*arrays, *place], [*_NAMES, "part", "last", "edge_id", "edge_text"])


#: Bytes of texts whose pairs are compared together.
PAIR_BYTES = 4 << 20


def edited_neighbours(documents: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text) and of their edited texts, and how alike they are."""
    ship(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc(), F.col("text").asc()]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, met, held = None, [], 0  # the row before, pairs of rows to compare
        for b in batches:
            for i in range(b.num_rows):
                doc_id, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                row = (doc_id, text, fingerprint(text.encode()))
                if before is None:
                    yield _batch([], [(part, False, doc_id, text)])
                else:
                    met.append((*before, *row[1:]))
                    held += len(before[1])
                before = row
                if held > PAIR_BYTES or len(met) >= 1_000:
                    yield _batch(_compared(met), [])
                    met, held = [], 0
        if met:
            yield _batch(_compared(met), [])
        if before is not None:
            yield _batch([], [(part, True, *before[:2])])

    found = materialize(dealt.mapInArrow(trimmed(run), f"{FIELDS}, part int, last boolean, edge_id long, edge_text string"), "context-hash")
    return found.filter("part IS NULL").select(*_NAMES).unionByName(_across(found.filter("part IS NOT NULL")))


def _across(edges: DataFrame) -> DataFrame:
    """The last document of each range with the first one of the next, the very last with the very first."""
    parts = sorted(r["part"] for r in edges.filter("last").select("part").collect())  # a number for each range
    pairs = edges.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    first = edges.filter("NOT last").select(F.col("part").alias("next"), F.col("edge_text").alias("following"))
    met = edges.filter("last").select("part", F.col("edge_id").alias("doc_id"), F.col("edge_text").alias("text")).join(pairs, "part").join(first, "next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc_id, text, after = (b.column(k)[i].as_py() for k in range(3))
                columns = _compared([(doc_id, text, fingerprint(text.encode()), after, fingerprint(after.encode()))])
                yield _batch(columns, []).select(_NAMES)

    return met.select("doc_id", "text", "following").mapInArrow(trimmed(run), FIELDS)

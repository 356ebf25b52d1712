"""Best-fit packing of tokenised documents by linear grouping.

Documents become token ids plus an end id; longer ones are cut into pieces of
the sequence length.  Packing sees only how many pieces have which length (at
most ``capacity`` numbers, so the driver's share is bounded whatever the input):

1. large lengths, in descending order, are cut into groups of equal
   cardinality and rounded up to the largest of their group;
2. configurations over these few sizes are optimised by column generation
   (Gilmore and Gomory), with a knapsack over the capacity as pricing, and the
   linear programme's solution is rounded down;
3. actual pieces are substituted for the rounded ones: each place but the last
   takes the largest piece its size allows, the last place the largest piece
   that the actual pieces before it leave room for, so that rounding up costs
   no room that only tiny pieces could fill;
4. what rounding down left over and the small pieces go best-fit, largest
   first, into the room that is left, and into new sequences where none is.

The plan says for a run of pieces of one length which sequences and which offset
they take.  Pieces get their rank within their length by distributed prefix
sums, and look their place up in the plan.

Edge cases: a null or empty text is the end id alone; a very long text is cut
into as many pieces as it needs; documents with equal or null ids and repeated
rows are packed one by one; an empty table gives an empty result; other columns
(also ones named like the result's) are left out.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_offsets, ship, trimmed

CAPACITY, END_ID = 2_048, 0
#: Large pieces are over one of these parts of a sequence: two or more share one.
#: Over half no two do, so the last is best fit alone; it counts only if it needs fewer.
SHARES = (3, 4, 6, 32, 2)

# The splitter of the word tokenizer, as its file states it.
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters for which Python's lower() and classes agree with that tokenizer's
#: (no combining marks, no special tokens); texts with others are encoded whole.
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_ODD = re.compile("[^\x00-\x7f" + _LETTERS + "\xc0-\xd6\xd8-\xde]|<[|]")
_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[" + _LETTERS + r"]+|[0-9]|[^\t-\r 0-9" + _LETTERS + "]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(rest)}


class _Parts(dict):
    """Ids of parts by part, found by the BPE model when first asked for.

    Two generations of at most ``most`` bytes each (estimated): a full one
    becomes the old one, and what is asked for again comes back from there.
    """

    #: Bytes that an entry takes besides its characters and ids.
    ENTRY = 250

    def __init__(self, model, most: int):
        self.model, self.letters, self.most = model, _byte_letters(), most
        self.old: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, part: str) -> bytes:
        if (ids := self.old.pop(part, None)) is None:
            shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self.held += self.ENTRY + 4 * len(part) + len(ids)
        if self.held > self.most:
            self.forget(old=False)
        self[part] = ids
        return ids

    def forget(self, old: bool = True) -> None:
        self.old = {} if old else dict(self)
        self.clear()
        self.held = 0


class WordEncoder:
    """Token ids of texts as little-endian 32-bit bytes.

    Parts of texts are remembered in at most twice ``most`` bytes.

    Equal to encoding the whole text: the word tokenizer lower-cases, splits by
    a rule that does not look across white space, and encodes each part by
    itself.  So texts are split here and each distinct part is encoded once.
    """

    def __init__(self, path: str | None = None, most: int = 40_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tok = Tokenizer.from_file(path)
        steps = json.loads(self.tok.to_str())
        rule = ((steps.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.known = rule == SPLIT_RULE and sys.byteorder == "little"
        self.parts = _Parts(self.tok.model, most)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.known or (("<|" in text) if text.isascii() else _ODD.search(text)):
            return self._whole(text)
        return b"".join(map(self.parts.__getitem__, _TOKENS.findall(text.lower())))


@lru_cache(maxsize=1)
def _encoder(path: str | None) -> WordEncoder:
    return WordEncoder(path)


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    ship(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = _encoder(tokenizer), ["doc_id", "piece", "start", "length", "ids_crc32"]
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0), b.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc.as_py(), k, at // 4, len(part) // 4, crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names)
        enc.parts.forget()  # workers live on and serve other stages

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the plan


def best_pattern(sizes: np.ndarray, gains: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within ``capacity`` of greatest gain (unbounded knapsack)."""
    use = np.flatnonzero(gains > 1e-12)
    s, y = sizes[use], gains[use]
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(s, kind="stable")
    s, y, use = s[order], y[order], use[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for w in range(1, capacity + 1):
        value[w] = value[w - 1]
        if k := fits[w]:
            v = value[w - s[:k]] + y[:k]
            if v[j := int(v.argmax())] > value[w] + 1e-12:
                value[w], took[w] = v[j], j
    out, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            out[use[took[w]]] += 1
            w -= s[took[w]]
    return out


def optimise_configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 500) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole multiplicities that do not exceed ``counts`` by much.

    Revised simplex over patterns: the basis starts with one size to a pattern,
    each round prices by knapsack.  Any basis is a solution, so ``rounds`` only
    bounds the driver's work.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, cost = inverse @ counts, (basis.min(axis=0) >= 0).astype(float)
        y = cost @ inverse
        if y.min() < -1e-9:
            enter, reduced = np.zeros(k), -y.min()
            enter[int(y.argmin())] = -1.0  # a surplus column
        else:
            enter = best_pattern(sizes, y, capacity).astype(float)
            reduced = y @ enter - 1
        if reduced < 1e-7:
            break
        d = inverse @ enter
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = enter
    x = np.linalg.solve(basis, counts.astype(float))
    return [(basis[:, i].astype(np.int64), int(x[i] + 1e-6)) for i in range(k) if basis[:, i].min() >= 0 and x[i] >= 1 - 1e-6]


def least_sequences(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """No plan has fewer: all ids fill them, and pieces over half a sequence never share one."""
    return max(-(-int((counts * np.arange(capacity + 1)).sum()) // capacity), int(counts[capacity // 2 + 1 :].sum()))


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, small: int | None = None, groups: int = 96) -> tuple[np.ndarray, int]:
    """Places for counts[length] pieces of each length, and the number of sequences.

    Rows of the plan: (length, first rank, pieces, first sequence, offset): the
    pieces of that length from that rank on take one sequence each, in order.

    Lengths over ``small`` are large.  Unless it is given, plans are made with
    several shares of a sequence, and the one with the fewest sequences is kept.
    """
    if small is not None:
        return _plan(counts, capacity, small, groups)
    best, least = None, least_sequences(counts, capacity)
    for parts in SHARES:
        found = _plan(counts, capacity, capacity // parts, groups)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] == least:
            break
    return best


def group_sizes(counts: np.ndarray, small: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Large lengths rounded up: (sizes, how many pieces of each), largest first.

    The pieces in descending order are cut into groups of equal cardinality (a
    length may be cut); groups whose largest piece is the same are one size.
    """
    large = [int(s) for s in range(len(counts) - 2, small, -1) if counts[s]]
    if not large:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    share = -(-int(sum(counts[s] for s in large)) // groups)
    size, held, found = large[0], 0, {}
    for s in large:
        left = int(counts[s])
        while left:
            if held == share:
                size, held = s, 0
            n = min(left, share - held)
            found[size] = found.get(size, 0) + n
            held, left = held + n, left - n
    return np.array(list(found)), np.array(list(found.values()))


def substitute(pattern: list[int], left: np.ndarray, capacity: int) -> dict[int, int]:
    """Actual lengths (and how often each) for a pattern's sizes, from ``left`` by length."""

    def most(limit: int) -> int:
        there = np.flatnonzero(left[: limit + 1] > taken[: limit + 1])
        return int(there[-1]) if len(there) else 0

    taken, room = np.zeros_like(left), capacity
    for k, size in enumerate(pattern, 1):
        if s := most(min(room, size) if k < len(pattern) else room):
            taken[s] += 1
            room -= s
    return {int(s): int(taken[s]) for s in np.flatnonzero(taken)}


def _plan(counts: np.ndarray, capacity: int, small: int, groups: int) -> tuple[np.ndarray, int]:
    segments: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(capacity + 1, np.int64)  # ranks handed out, by length
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # free room -> (first sequence, how many)
    free = np.zeros(capacity + 1, bool)
    total = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        segments.append((length, int(used[length]), n, first, offset))
        used[length] += n

    def open_room(left: int, first: int, n: int) -> None:
        if left and n:
            room[left].append((first, n))
            free[left] = True

    if n := int(counts[capacity]):
        put(capacity, n, 0, 0)
        total = n
    rest = counts.astype(np.int64).copy()
    rest[capacity] = 0
    sizes, demand = group_sizes(counts, small, groups)
    large = np.where(np.arange(capacity + 1) > small, rest, 0)
    found = optimise_configurations(sizes, demand, capacity) if len(sizes) else []
    for pattern, times in sorted(found, key=lambda x: (-int(sizes[np.flatnonzero(x[0])].max()), tuple(x[0]))):
        slots = [int(sizes[g]) for g in np.flatnonzero(pattern) for _ in range(pattern[g])]
        while times and (picks := substitute(slots, large, capacity)):
            n = min(times, *(int(large[s]) // k for s, k in picks.items()))
            offset = 0
            for s, k in picks.items():
                for _ in range(k):
                    put(s, n, total, offset)
                    offset += s
                rest[s] -= n * k
                large[s] -= n * k
            open_room(capacity - offset, total, n)
            total += n
            times -= n
    # Best fit, largest first, into the room that is left.
    for s in range(capacity - 1, 0, -1):
        left = int(rest[s])
        while left:
            fits = np.flatnonzero(free[s:])
            if len(fits):
                r = s + int(fits[0])
                first, n = room[r].pop()
                free[r] = bool(room[r])
                k = min(n, left)
                put(s, k, first, capacity - r)
                open_room(r - s, first, k)
                open_room(r, first + k, n - k)
            else:
                k = -(-left // (capacity // s))
                put(s, k, total, 0)
                open_room(capacity - s, total, k)
                total += k
            left -= k
    return np.array(sorted(segments), np.int64).reshape(-1, 5), total


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, groups: int = 96) -> DataFrame:
    """Every piece with its sequence and the offset there."""
    pieces = materialize(cut_pieces(docs, capacity, tokenizer), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    plan, _ = plan_packing(counts, capacity, groups=groups)
    order = [F.xxhash64("doc_id", "piece"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = running_offsets(pieces, "length", order, F.lit(1), "_rank")
    base = int(counts.sum()) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] * base + plan[:, 1]
        for b in batches:
            cols = b.columns
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * base + rank, "right") - 1
            sequence = plan[at, 3] + rank - plan[at, 1]
            yield pa.RecordBatch.from_arrays([*cols[:5], pa.array(sequence), pa.array(plan[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ordered = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast("long").alias("_rank"))
    return ordered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

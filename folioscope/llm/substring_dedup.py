"""Substring dedup: repeated word windows by prefix-partitioned suffix trees.

A window (``window`` consecutive words of one document) is repeated if the same
words also start anywhere else.  In the suffix tree of all documents, cut off
below that depth, repeated windows are the leaves below internal nodes of full
depth.  The tree is never built in one place:

1. *Which suffixes can matter.*  Every window contains a minimiser: the 8-word
   shingle of least hash.  Windows next to each other that share one form a zone
   (about 14 windows); equal windows have equal minimisers, so a zone whose
   minimiser occurs once holds no repeat.  This only rules suffixes out.
2. *Equal zones.*  Zones of the same words are counted (combined before the
   shuffle) and one stands for all, with its count as the weight of its leaves.
   Equal here means a 128-bit hash under a key drawn for each run.
3. *Partitioning by variable-length prefixes.*  The words of every standing zone
   go to the group of its minimiser, the 8-word prefix that its suffixes share.
   A prefix that more than ``group_rows`` zones share is lengthened: its windows
   go on by themselves, to groups of their first 16, 24 or all words, each
   length taking only what is crowded at the one before.  What is crowded is a
   table like any other; the driver sees counts only.
4. *Subtrees.*  A group sorts its suffixes by words (prefix doubling over the
   words themselves, no hashes), takes the longest common prefixes of neighbours
   and cuts the tree's nodes at full depth from them.  A node whose leaves weigh
   two or more is a repeat; its leaves are reported as ranges of their zones.

Back in the documents, every zone of those words is marked.  Joins are
equi-joins on row keys or zone hashes.

Edge cases: a null, empty or short text has no window and is kept as it is (its
words joined by one space); repeated rows are repeats of each other; rows are
told apart by a keyed 128-bit hash of id and text, so equal or null ids are no
trouble; a very long text is worked on whole, in memory that grows with it; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, ship, trimmed

SHINGLE = 8
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The first n bytes of a little-endian word of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_M2, _M3 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

#: Bytes of text worked on at a time.
SLICE = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


class Key:
    """What makes hashes of a run unforeseeable: 32 random bytes, odd numbers drawn from them."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.odd = np.frombuffer(hashlib.shake_256(raw).digest(8 * 10), "<u8").astype(np.uint64) | _U(1)

    def pair(self, lane: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words of a followed by those of b."""
        return _mix(a * self.odd[lane] + (b ^ (b >> _U(17))) * self.odd[2 + lane])


class Words:
    """The words of some texts (one byte array, ``cuts`` between texts), hashed."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray):
        self.data = data
        space = _SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = cuts[:-1][np.diff(cuts) > 0]
        before[inner] = True
        after[inner[inner > 0] - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, cuts)  # first word of each text, and the end
        self.text = np.repeat(np.arange(len(cuts) - 1), np.diff(self.first))

    def lanes(self, key: Key) -> list[np.ndarray]:
        """Two 64-bit hashes of every word, 128 bits together.

        Words of up to 16 bytes enter as they are, longer ones as a keyed digest.
        """
        length = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        low = eight[self.start] & _FIRST[np.minimum(length, 8)]
        high = eight[self.start + 8] & _FIRST[np.clip(length - 8, 0, 8)]
        raw = self.data.data
        for i in np.flatnonzero(length > 16):
            d = hashlib.blake2b(raw[self.start[i] : self.end[i]], digest_size=16, key=key.raw).digest()
            low[i], high[i] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")
        n, k = length.astype(np.uint64), key.odd
        return [_mix(_mix(low ^ k[4]) + high * k[5] + n * k[6]), _mix(_mix(high ^ k[7]) + low * k[8] + n * k[9])]


class Zones:
    """Windows of some texts and the zones that their minimisers part them into."""

    def __init__(self, words: Words, window: int, key: Key):
        self.words = words
        n = len(words.start)
        m = max(0, n - window + 1)
        whole = []
        for lane, h in enumerate(words.lanes(key)):
            levels, size = {1: h}, 1
            while size * 2 <= window:
                a = levels[size]
                k = max(0, n - 2 * size + 1)
                levels[2 * size] = key.pair(lane, a[:k], a[size : size + k]) if k else a[:0]
                size *= 2
            if not lane:
                shingles = levels[SHINGLE]
            w, at = levels[size][:m], size
            for bit in reversed(range(size.bit_length() - 1)):
                if (window - size) >> bit & 1:
                    w = key.pair(lane, w, levels[1 << bit][at : at + m])
                    at += 1 << bit
            whole.append(w)
        valid = words.text[:m] == words.text[window - 1 :][:m] if m else np.zeros(0, bool)
        # Leftmost least shingle hash among the shingles of each window.
        span = window - SHINGLE + 1
        low, pos, got = shingles, np.arange(len(shingles)), 1
        while got < span:
            step = min(got, span - got)
            k = len(low) - step
            take = low[:k] <= low[step:]
            low, pos, got = np.where(take, low[:k], low[step:]), np.where(take, pos[:k], pos[step:]), got + step
        low, pos = low[:m], pos[:m]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (pos[1:] != pos[:-1]) if m else False
        self.begin = np.flatnonzero(fresh)
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (pos[1:] != pos[:-1]) if m else False
        self.stop = np.flatnonzero(last) + 1
        self.key = low[self.begin]
        count = (self.stop - self.begin).astype(np.uint64)
        self.whole = [_mix(key.pair(i, w[self.begin], w[self.stop - 1]) + count * key.odd[4]) for i, w in enumerate(whole)]
        self.text = words.text[self.begin] if len(self.begin) else np.zeros(0, np.int64)
        self.place = self.begin - words.first[self.text]


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, cuts) of runs of rows of some MB."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _find_zones(window: int, key: Key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, _, data, cuts in _slices(b.column(2)):
                z = Zones(Words(data, cuts), window, key)
                yield _rows(d1=d1[row + z.text], d2=d2[row + z.text], at=z.place.astype(np.int32), len=(z.stop - z.begin).astype(np.int32), k=_signed(z.key), s1=_signed(z.whole[0]), s2=_signed(z.whole[1]))

    return run


_ZONE = "k long, forks long, s1 long, s2 long, off int, n long, words string"


def _send_zones(window: int):
    """The words of the zones that documents stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, zones in zip(b.column(0), b.column(1)):
                words = text.as_py().encode().split()
                rows = [(z["k"], z["forks"], z["s1"], z["s2"], 0, z["n"], b" ".join(words[z["at"] : z["at"] + z["len"] - 1 + window]).decode()) for z in zones.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.string()])], ["k", "forks", "s1", "s2", "off", "n", "words"])

    return run


class SuffixTree:
    """The suffixes of some word sequences in order, cut off below ``depth`` words.

    ``texts``: sequences of words joined by a space.  Suffixes shorter than
    ``depth`` are left out.
    """

    def __init__(self, texts: list[str], depth: int):
        number: dict[str, int] = {}
        split = [t.split(" ") for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        ranks = {1: np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int64)}
        n = len(ranks[1])
        self.first = np.cumsum(sizes) - sizes
        end = np.repeat(self.first + sizes, sizes)
        self.row = np.repeat(np.arange(len(texts)), sizes)
        # Prefix doubling: the rank of 2 * size words from the ranks of two halves.
        size = 1
        while size * 2 <= depth:
            a = ranks[size]
            k = max(0, n - 2 * size + 1)
            pairs = a[:k] * (int(a.max(initial=0)) + 1) + a[size : size + k]
            ranks[2 * size] = np.unique(pairs, return_inverse=True)[1].reshape(-1)
            size *= 2
        start = np.flatnonzero(end - np.arange(n) >= depth)
        # The rank of ``depth`` words: of the first and the last ``size`` of them.
        last = start + depth - size
        self.start = start[np.lexsort((ranks[size][last], ranks[size][start]))] if len(start) else start
        self.ranks, self.end, self.depth = ranks, end, depth

    def common_prefixes(self) -> np.ndarray:
        """Words that each suffix shares with the one before it in order, up to twice the largest power of two."""
        a, b = self.start[:-1], self.start[1:]
        most = np.minimum(self.end[a] - a, self.end[b] - b) if len(a) else np.zeros(0, np.int64)
        out = np.zeros(len(a), np.int64)
        for size in sorted(self.ranks, reverse=True):
            r = self.ranks[size]
            fits = out + size <= most
            x, y = np.where(fits, a + out, 0), np.where(fits, b + out, 0)
            out += size * (fits & (r[x] == r[y]))
        return np.concatenate([np.zeros(min(1, len(self.start)), np.int64), out])

    def nodes(self) -> np.ndarray:
        """The number of the node of full depth above each suffix, in order."""
        return np.cumsum(self.common_prefixes() < self.depth)

    def repeats(self, weights: np.ndarray) -> np.ndarray:
        """Starts of suffixes below nodes of full depth whose leaves weigh two or more."""
        node = self.nodes()
        heavy = np.bincount(node, weights[self.row[self.start]], minlength=1) >= 2
        return np.sort(self.start[heavy[node]])


def _subtree(window: int):
    """(s1, s2, low, high): ranges of repeated windows of the zones of a group."""

    def run(table: pa.Table) -> pa.Table:
        tree = SuffixTree(table.column("words").to_pylist(), window)
        at = tree.repeats(table.column("n").to_numpy().astype(float))
        row = tree.row[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(row) != 0)
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(at)) - 1 if len(at) else begin
        row = row[begin]
        off = table.column("off").to_numpy()[row] - tree.first[row]
        s1, s2 = (table.column(c).to_numpy()[row] for c in ("s1", "s2"))
        return pa.table({"s1": s1, "s2": s2, "low": (at[begin] + off).astype(np.int32), "high": (at[stop] + 1 + off).astype(np.int32)})

    return run


def _windows(window: int):
    """Each window of a zone by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                words = r["words"].split(" ")
                rows = [{**r, "off": i, "words": " ".join(words[i : i + window])} for i in range(len(words) - window + 1)]
                yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return run


def _trees(rows: DataFrame, group: Column, window: int, group_rows: int) -> DataFrame:
    """Subtrees of groups, several groups to a task."""
    tasks = max(1, -(-rows.count() // group_rows))
    dealt = rows.select("s1", "s2", "off", "n", "words", F.pmod(F.xxhash64(group), F.lit(tasks)).alias("task"))
    return dealt.groupBy("task").applyInArrow(_subtree(window), "s1 long, s2 long, low int, high int")


def _repeated_ranges(zones: DataFrame, window: int, group_rows: int) -> DataFrame:
    """(s1, s2, low, high) of the zones whose words are given, group by group."""
    found = _trees(zones.filter(F.col("forks") <= group_rows), F.col("k"), window, group_rows)
    held = zones.filter(F.col("forks") > group_rows)
    if not held.limit(1).count():
        return found
    held = materialize(held.mapInArrow(trimmed(_windows(window)), _ZONE), "windows")
    lengths = [n for n in (2 * SHINGLE, 3 * SHINGLE) if n < window]
    for n in lengths:
        held = held.withColumn("_g", F.xxhash64(F.substring_index("words", " ", n)))
        crowded = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > group_rows).select(F.col("_g").alias("_k"))
        crowded = materialize(crowded, "crowded-prefixes")
        done = held.join(crowded, held["_g"] == crowded["_k"], "left_anti")
        found = found.unionByName(_trees(done, F.col("_g"), window, group_rows))
        held = materialize(held.join(crowded, held["_g"] == crowded["_k"], "left_semi").drop("_g"), "windows")
    # Whole windows that still crowd are nodes of full depth: their leaves are counted.
    heavy = held.groupBy("words").agg(F.sum("n").alias("_n")).filter("_n >= 2").select(F.col("words").alias("_w"))
    last = held.join(heavy, held["words"] == heavy["_w"], "left_semi")
    return found.unionByName(last.select("s1", "s2", F.col("off").alias("low"), (F.col("off") + 1).alias("high")))


def _keyed(docs: DataFrame, key: Key) -> DataFrame:
    """Every row with its key (d1, d2) and its text."""
    a, b = (int(x) for x in np.frombuffer(hashlib.blake2b(key.raw, digest_size=16).digest(), np.int64))
    row = lambda x: F.xxhash64(F.lit(x), F.col("doc_id").cast("long"), F.col("text"))
    return docs.withColumn("_d1", row(a)).withColumn("_d2", row(b))


def repeated_windows(docs: DataFrame, key: Key, window: int = 35, group_rows: int = 8_192) -> DataFrame:
    """(d1, d2, ranges): per document with repeats the ranges (from, to) of starts of
    repeated windows, as word numbers."""
    ship(docs.sparkSession)
    keyed = _keyed(docs, key).select(F.col("_d1").alias("d1"), F.col("_d2").alias("d2"), F.coalesce("text", F.lit("")).alias("text"))
    zones = materialize(keyed.mapInArrow(trimmed(_find_zones(window, key)), "d1 long, d2 long, at int, len int, k long, s1 long, s2 long"), "zones")
    # Counts are tables of their own, so that both sides of each join are plain
    # exchanges and a minimiser with any share of the zones can be split.
    often = zones.groupBy("k").agg(F.count(F.lit(1)).alias("_t")).filter("_t > 1").select(F.col("k").alias("_k"))
    often = materialize(often, "shared-minimisers")
    shared = materialize(zones.join(often, zones["k"] == often["_k"]).drop("_k"), "shared-zones")
    release(zones, often)
    alike = shared.groupBy("k", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d1", "d2", "at", "len")).alias("z"))
    alike = materialize(alike, "alike-zones")
    forks = materialize(alike.groupBy(F.col("k").alias("_k")).agg(F.count(F.lit(1)).alias("forks")), "forks")
    stand = alike.join(forks, alike["k"] == forks["_k"])
    zone = F.struct(F.col("z.at").alias("at"), F.col("z.len").alias("len"), "k", "forks", "s1", "s2", "n")
    send = stand.groupBy(F.col("z.d1").alias("_a"), F.col("z.d2").alias("_b")).agg(F.collect_list(zone).alias("zones"))
    asked = keyed.join(send, (keyed["d1"] == send["_a"]) & (keyed["d2"] == send["_b"])).dropDuplicates(["d1", "d2"]).select("text", "zones")
    sent = materialize(asked.mapInArrow(trimmed(_send_zones(window)), _ZONE), "zone-words")
    release(alike, forks)
    ranges = materialize(_repeated_ranges(sent, window, group_rows), "ranges").select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "low", "high")
    met = shared.join(ranges, (shared["s1"] == ranges["_s1"]) & (shared["s2"] == ranges["_s2"]))
    met = met.select("d1", "d2", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))
    found = materialize(met.groupBy("d1", "d2").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "repeats")
    release(shared, sent)
    return found


def _keep(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, cuts in _slices(b.column(1)):
                words = Words(data, cuts)
                covered = np.zeros(len(words.start) + 1, np.int64)
                part = b.column(2).slice(row, end - row)
                n = np.array([len(x) if x.is_valid else 0 for x in part])
                if n.sum():
                    low, high = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in part.flatten().flatten())
                    at = np.repeat(words.first[:-1], n)
                    np.add.at(covered, at + low, 1)
                    np.add.at(covered, at + high - 1 + window, -1)
                keep = np.cumsum(covered[:-1]) == 0
                raw, first = data.tobytes(), words.first
                texts = []
                for i in range(end - row):
                    every = raw[cuts[i] : cuts[i + 1]].split()
                    mask = keep[first[i] : first[i + 1]]
                    texts.append(b" ".join(every if mask.all() else [every[j] for j in np.flatnonzero(mask)]))
                n = np.diff(first)
                kept = np.add.reduceat(np.append(keep, False), first[:-1]) * (n > 0) if len(n) else n
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, end - row), pa.array(n.astype(np.int64)), pa.array((n - kept).astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode() for t in texts], pa.string())],
                    ["row", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, window: int = 35, digest: bool = False, carry: list[str] | None = None, group_rows: int = 8_192) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed and kept.

    ``kept`` is the text of the words that no repeated window covers, joined by
    one space, or with ``digest`` the SHA-256 of it.  ``carry`` names further
    columns to keep beside doc_id.
    """
    key = Key(os.urandom(32))
    found = repeated_windows(docs, key, window, group_rows)
    names = ["doc_id", *[c for c in carry or [] if c not in ("doc_id", "text")]]
    keyed = _keyed(docs, key).select(F.col("_d1").alias("_a"), F.col("_d2").alias("_b"), F.struct(*names).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    joined = keyed.join(found, (keyed["_a"] == found["d1"]) & (keyed["_b"] == found["d2"]), "left").select("row", "text", "ranges")
    row = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(trimmed(_keep(window, digest)), f"row {row}, n_words long, n_removed long, kept string")
    return out.select(*[F.col("row")[c].alias(c) for c in names], "n_words", "n_removed", "kept")

"""SimHash near-duplicates by the generalised pigeonhole principle.

``fingerprints`` makes a 64-bit SimHash of word shingles.  ``link_fingerprints``
finds all pairs within ``distance`` bits: the bits are cut into m partitions (m
by the number of fingerprints: the more there are, the wider partitions must be
to tell them apart), correlated bits into the same one; every fingerprint gets
its own thresholds per partition by dynamic programming on estimated candidate
counts (they sum to distance - m + 1, -1 skips a partition), probes the values
within those thresholds, and verifies.  Equal fingerprints are one
representative, so copies cost one row.

What reaches the driver is bounded whatever the input: a 64 x 64 matrix of bit
counts and, per partition, one histogram of the 2**16 values of its first bits.  A partition value held
by many fingerprints is cut into square tiles, and a group of tiles yields a
spanning forest of its links, not the links.

Edge cases: a null, empty or blank text has fingerprint zero and links like any
other; fewer words than a shingle make one shingle; a very long text is hashed
whole; ties at half the shingles give a 0 bit; documents with equal ids are one
node; a null doc_id is linked with nothing and its component is null; an empty
table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, trimmed
from .components import connected_components, forest

#: Partitions at most, and bits of a partition that histograms tell apart.
MOST_PARTS, WIDTH = 4, 16
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle in order, repeats included (A-Z lower-cased); none of a blank text."""
    words = (text or "").encode().lower().split()  # ASCII case and white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bit i is 1 if set in over half of the hashes."""
    n = len(h)
    h = np.concatenate([h, np.zeros(-n % 255, np.uint64)]).reshape(-1, 255)
    bits = 0
    for k in range(8):  # byte lanes: lane j of shift k counts bit 8 * j + k, at most 255 to a lane
        lanes = ((h >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for j in np.flatnonzero(counts * 2 > n):
            bits |= 1 << int(8 * j + k)
    return bits


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text's shingles; zero without words."""
    return fingerprint(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp as a signed long, from whole texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def widths(parts: int) -> list[int]:
    """Bits of each partition, as even as can be."""
    return [64 // parts + (i < 64 % parts) for i in range(parts)]


def _ball(width: int, t: int) -> int:
    return sum(comb(width, k) for k in range(t + 1))


#: Comparisons that cost as much as shuffling one probe.
PROBE_COST = 100


def choose_parts(n: int, distance: int) -> int:
    """Partitions of least probes and candidates for n evenly spread fingerprints."""

    def cost(parts: int) -> float:
        price = [[0.0, *(_ball(w, t) * (PROBE_COST + n / 2.0**w) for t in range(distance + 1))] for w in widths(parts)]
        best = {0: 0.0}  # thresholds + 1 so far -> least price
        for row in price:
            best = {k: min(best[k - t] + row[t] for t in range(len(row)) if k - t in best) for k in range(max(best) + len(row))}
        return best[distance + 1]  # they sum to distance - parts + 1

    return min(range(min(MOST_PARTS, distance + 1), 0, -1), key=cost)


def bit_order(reps: DataFrame, parts: int = MOST_PARTS) -> list[int]:
    """Bits grouped so that correlated ones share a partition (GPH's first step)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for b in batches:
            x = np.ones((b.num_rows, 65))
            x[:, :64] = _bits(b.column(0).to_numpy())
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])

    rows = reps.select("fp").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # at most 65 x 65
    c = np.zeros((65, 65))
    for r in rows:
        c[r["i"], r["j"]] = r["n"]
    n = max(1.0, c[64, 64])
    p = c[64, :64] / n
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((c[:64, :64] / n - np.outer(p, p)) / np.outer(dev, dev))
    left, order = set(range(64)), []
    for width in widths(parts):
        group = [min(left)]
        while len(group) < width:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        left -= set(group)
        order += group
    return order


def part_values(fp: np.ndarray, order: list[int], parts: int) -> np.ndarray:
    """(n, parts) values of the partitions under that order of bits."""
    bits, at, out = _bits(fp)[:, order].astype(np.uint64), 0, []
    for width in widths(parts):
        out.append(bits[:, at : at + width] @ (np.uint64(1) << np.arange(width, dtype=np.uint64)))
        at += width
    return np.stack(out, axis=1).view(np.int64)


def ball_counts(hist: np.ndarray, most: int, width: int = WIDTH) -> np.ndarray:
    """(most + 1, 2**WIDTH): about how many fingerprints lie within t bits of a
    value whose first bits are given; exact if a partition has no more bits."""
    exact = np.zeros((most + 1, hist.size), np.int64)
    exact[0] = hist
    at = np.arange(hist.size)
    for b in range(WIDTH):
        moved = exact[:, at ^ (1 << b)]
        exact[1:] += moved[:-1]
    rest = width - WIDTH
    if not rest:
        return np.cumsum(exact, axis=0)
    return np.stack([sum(exact[s] * (_ball(rest, t - s) / 2.0**rest) for s in range(t + 1)) for t in range(most + 1)])


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds (n, parts), each >= -1 and summing to ``total``, of least summed cost.

    costs: (n, parts, t) for threshold t = 0, 1, ...; -1 costs nothing.
    """
    n, parts, most = costs.shape
    low, high = -parts, max(total, 0) + parts
    width = high - low + 1
    best = np.full((n, width), np.inf)
    best[:, -low] = 0
    took = []
    for i in range(parts):
        new, arg = np.full((n, width), np.inf), np.zeros((n, width), np.int64)
        for t in range(-1, most):
            cost = costs[:, i, t][:, None] if t >= 0 else 0.0
            cand = np.full((n, width), np.inf)
            if t < 0:
                cand[:, :-1] = best[:, 1:]
            else:
                cand[:, t:] = best[:, : width - t]
            cand = cand + cost
            better = cand < new
            new[better], arg[better] = cand[better], t
        best = new
        took.append(arg)
    out, s = np.zeros((n, parts), np.int64), np.full(n, total - low)
    for i in reversed(range(parts)):
        out[:, i] = took[i][np.arange(n), s]
        s = s - out[:, i]
    return out


def _masks(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], np.uint64).view(np.int64)


_ROWS = pa.schema([("tile", pa.int64()), ("fp", pa.int64()), ("rep", pa.int64()), ("probe", pa.bool_())])


def _deal(order: list[int], hist: np.ndarray, balls: np.ndarray, distance: int, side: int):
    """Index rows and probe rows of each fingerprint, keyed by tile.

    A value whose first bits h fingerprints share has ceil(h / side) index
    stripes and about as many probe stripes as its probes need; a tile is a
    hash of (part, value, stripes): if two meet, only more is verified.
    """
    most, parts = distance + 1, len(hist)
    first = np.int64((1 << WIDTH) - 1)
    prime = [np.int64(x) for x in (0x1E3779B97F4A7C15, 0x3F58476D1CE4E5B9, 0x14D049BB133111EB, 0x2545F4914F6CDD1D)]

    def stripes(i: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.ceil(balls[i, min(2, most - 1), v & first]).astype(np.int64)
        return np.maximum(1, -(-hist[i, v & first] // side)), np.maximum(1, -(-near // side))

    def key(i: int, v: np.ndarray, d: np.ndarray, p: np.ndarray) -> np.ndarray:
        x = (v * prime[0]) ^ (d * prime[1]) ^ (p * prime[2]) ^ np.int64(i + 1) * prime[3]
        return x ^ (x >> 29)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        total = distance - parts + 1
        masks = [[_masks(w, t) for t in range(min(most, total + parts))] for w in widths(parts)]
        for b in batches:
            fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            values = part_values(fp, order, parts)
            costs = np.stack([balls[i][: len(masks[i]), values[:, i] & first].T + np.array([len(m) for m in masks[i]]) for i in range(parts)], axis=1).astype(float)
            take = allocate(costs, total)
            out = []
            for i in range(parts):
                nd, npr = stripes(i, values[:, i])
                at = np.repeat(np.arange(len(fp)), npr)  # index rows go to every probe stripe
                step = np.arange(len(at)) - np.repeat(np.cumsum(npr) - npr, npr)
                out.append((key(i, values[at, i], own[at] % nd[at], step), at, False))
                for t, mask in enumerate(masks[i]):
                    who = np.flatnonzero(take[:, i] == t)
                    for some in np.array_split(who, max(1, len(who) * len(mask) // 1_000_000)):
                        v = (values[some, i][:, None] ^ mask).ravel()
                        at = np.repeat(some, len(mask))
                        there = hist[i, v & first] > 0
                        v, at = v[there], at[there]
                        nd, npr = stripes(i, v)
                        ex = np.repeat(np.arange(len(at)), nd)  # probes go to every index stripe
                        step = np.arange(len(ex)) - np.repeat(np.cumsum(nd) - nd, nd)
                        out.append((key(i, v[ex], step, own[at[ex]] % npr[ex]), at[ex], True))
            for tile, at, probe in out:
                for s in range(0, len(at), 200_000):
                    a = at[s : s + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(tile[s : s + 200_000]), pa.array(fp[a]), pa.array(rep[a]), pa.array(np.full(len(a), probe))], schema=_ROWS)

    return run


def _verify(distance: int):
    """All links of a bucket of tiles, as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        tile, fp, rep = (table.column(c).to_numpy() for c in ("tile", "fp", "rep"))
        probe = table.column("probe").to_numpy()
        order = np.argsort(tile[~probe], kind="stable")
        keys, data, owner = (x[~probe][order] for x in (tile, fp, rep))
        ask, want, asker = tile[probe], fp[probe], rep[probe]
        low, high = np.searchsorted(keys, ask), np.searchsorted(keys, ask, "right")
        count = high - low
        nodes, roots = [], []
        cuts = np.concatenate([[0], np.cumsum(count)])
        begin = 0
        while begin < len(ask):  # some millions of comparisons at a time
            end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + 4_000_000, "right")) - 1)
            n = count[begin:end]
            i = np.repeat(np.arange(begin, end), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[begin:end], n)
            close = (data[j] < want[i]) & (np.bitwise_count((data[j] ^ want[i]).view(np.uint64)) <= distance)
            if close.any():
                node, root = forest(asker[i[close]], owner[j[close]])
                nodes.append(node[node != root])
                roots.append(root[node != root])
            begin = end
        if nodes:
            node, root = forest(np.concatenate(nodes), np.concatenate(roots))
            node, root = node[node != root], root[node != root]
        else:
            node = root = np.empty(0, np.int64)
        return pa.table({"u": pa.array(node, pa.int64()), "v": pa.array(root, pa.int64())})

    return run


def link_fingerprints(reps: DataFrame, distance: int = 4, side: int = 4_096, rows_per_bucket: int = 40_000, parts: int | None = None) -> DataFrame:
    """(u, v): links whose components are those of all pairs within ``distance``.

    ``reps`` holds distinct (fp, rep).  ``parts`` partitions are made, the best
    number for that many fingerprints unless given.
    """
    ship(reps.sparkSession)
    n = reps.count()
    parts = parts or choose_parts(n, distance)
    order = bit_order(reps, parts)
    first = np.int64((1 << WIDTH) - 1)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = (part_values(b.column(0).to_numpy(), order, parts) & first) + (np.arange(parts) << WIDTH)
            v, n = np.unique(v, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n.astype(np.int64))], ["v", "n"])

    counted = reps.select("fp").mapInArrow(values, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).toPandas()  # at most parts * 2**WIDTH
    hist = np.zeros(parts << WIDTH, np.int64)
    hist[counted["v"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    hist = hist.reshape(parts, -1)
    balls = np.stack([ball_counts(h, distance, w) for h, w in zip(hist, widths(parts))])
    dealt = reps.select("fp", "rep").mapInArrow(trimmed(_deal(order, hist, balls, distance, side)), "tile long, fp long, rep long, probe boolean")
    buckets = max(1, n * (parts + 20) // rows_per_bucket)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(_verify(distance), "u long, v long")


def simhash_components(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    prints = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).dropna(), "representatives")
    links = link_fingerprints(reps, distance)
    # Documents that repeat an id with other texts tie their fingerprints together.
    again = prints.dropna().groupBy("doc_id").agg(F.min("fp").alias("_a"), F.max("fp").alias("_b")).filter("_a <> _b").select("doc_id")
    again = prints.join(again, "doc_id").join(reps, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    parts = connected_components(links.unionByName(again))
    known = reps.join(parts, reps["rep"] == parts["node"], "left").select(F.col("fp").alias("_f"), F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(known, prints["fp"] == known["_f"], "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) at Jaccard >= 0.8 of word shingles: fingerprint links
    first, then what they leave apart, every link verified (see ``near_copies``)."""
    from .near_copies import near_components

    return near_components(docs, shingle)

"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's bits are cut into m substrings of about log2(n) bits (n: the distinct
codes of an index), each with its own table, so a value is held by about one
code whatever n is.  Search radii grow one substring at a time: after probing
radius s in substrings 0..a (s - 1 in the rest) every code within distance
m * s + a has been seen, so a query is finished once its k-th verified distance
is covered.  Only codes that a probe meets are verified.

Rows are dealt into blocks and queries into chunks; each (block, chunk) pair
searches by itself, and the best k of all blocks are the answer.  Equal codes
are one entry of an index; ids of one code are dealt over the blocks like all
others, so copies crowd no task.

Edge cases: vectors that are null, empty or hold null or NaN have no code: they
are neither found nor searched for; codes of different lengths do not compare;
vectors may be of any width; ties in distance go to the smaller id; repeated
rows are found one by one; with fewer than k rows all are returned; an empty
table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ship

#: Bits to a word of a code as it is stored.
BITS = 16


@lru_cache(maxsize=200)
def shell(bits: int, radius: int) -> np.ndarray:
    """All masks of that many set bits among ``bits``."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)


def substring_lengths(width: int, n: int) -> list[int]:
    """Lengths of the substrings of ``width`` bits: as even as can be, about log2(n) each."""
    m = max(1, -(-width // max(2, round(np.log2(max(2, n))))))
    return [width // m + (i < width % m) for i in range(m)]


def _bits(words: np.ndarray, width: int) -> np.ndarray:
    """(n, width) bits of 16-bit words; the last word holds what is left over."""
    held = [min(BITS, width - at) for at in range(0, width, BITS)]
    return np.concatenate([words[:, [i]] >> np.arange(h)[::-1] & 1 for i, h in enumerate(held)], axis=1)


def _values(bits: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    cuts = np.cumsum([0, *lengths])
    return [bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in zip(cuts, cuts[1:])]


class Index:
    """Substring tables over distinct codes (rows of 16-bit words)."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, k: int, width: int):
        order = np.lexsort([ids, *codes.T])
        codes, ids = codes[order], ids[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]).any(axis=1)
        self.first, self.k, self.width = np.append(np.flatnonzero(new), len(codes)), k, width
        self.ids, self.codes = ids, codes[new]
        self.lengths = substring_lengths(width, len(self.codes))
        self.values = _values(_bits(self.codes, width), self.lengths)
        self.order = [np.argsort(v, kind="stable") for v in self.values]
        self.start = [np.searchsorted(v[o], np.arange((1 << n) + 1)) for v, o, n in zip(self.values, self.order, self.lengths)]

    def _probe(self, sub: int, values: np.ndarray) -> np.ndarray:
        low, high = self.start[sub][values], self.start[sub][values + 1]
        low, n = low[high > low], (high - low)[high > low]
        if not len(n):
            return np.empty(0, np.int64)
        return self.order[sub][np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest (ids, distances), and how many codes were verified."""
        m, n = len(self.lengths), len(self.codes)
        seen, size = np.zeros(n, bool), np.minimum(np.diff(self.first), self.k)
        at_distance = np.zeros(self.width + 1, np.int64)  # ids found so far, by distance
        distance = np.full(n, self.width + 1)
        own = [int(v[0]) for v in _values(_bits(query[None, :], self.width), self.lengths)]
        for s, a in ((s, a) for s in range(max(self.lengths) + 1) for a in range(m)):
            if s <= self.lengths[a]:
                met = self._probe(a, own[a] ^ shell(self.lengths[a], s))
                met = met[~seen[met]]  # the values of one substring are distinct, so no code comes twice
                seen[met] = True
                distance[met] = np.bitwise_count(self.codes[met] ^ query).sum(axis=1)
                at_distance += np.bincount(distance[met], size[met], self.width + 1).astype(np.int64)
            if at_distance[: m * s + a + 1].sum() >= self.k or seen.all():
                break
        got = np.flatnonzero(seen)
        got = got[np.argsort(distance[got], kind="stable")]
        got = got[: max(self.k, int(np.searchsorted(distance[got], distance[got][min(self.k, len(got)) - 1], "right")))] if len(got) else got
        take = size[got]
        ids = np.concatenate([self.ids[f : f + t] for f, t in zip(self.first[got], take)]) if len(got) else np.empty(0, np.int64)
        d = np.repeat(distance[got], take)
        best = np.lexsort([ids, d])[: self.k]
        return ids[best], d[best], int(seen.sum())


def _search(k: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words = np.stack(pdf["code"].to_numpy()).astype(np.int64)
        is_query = pdf["is_query"].to_numpy()
        ids = pdf["id"].to_numpy()
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "distance": np.empty(0, np.int32)})]
        if not is_query.all():
            index = Index(words[~is_query], ids[~is_query], k, int(key[0]))
            for q, w in zip(ids[is_query], words[is_query]):
                got, d, _ = index.search(w)
                out.append(pd.DataFrame({"query_id": q, "id": got, "distance": d.astype(np.int32)}))
        return pd.concat(out)

    return run


def sign_codes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): one bit per component, 1 if positive, as 16-bit words in an int array."""
    bad = lambda x: x.isNull() | F.isnan(x)
    sound = F.col(id_col).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)
    word = lambda w: F.aggregate(
        F.slice(vector, w * BITS + 1, BITS), F.lit(0), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0)
    )
    words = F.transform(F.sequence(F.lit(0), F.ceil(F.size(vector) / BITS).cast("int") - 1), word)
    return df.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), words.alias("code"), F.size(vector).alias("width"))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, block: int = 16_384, chunk: int = 16_384, least_tasks: int = 8) -> DataFrame:
    """query_id, rank, id, distance: the k nearest codes of every query, exactly.

    A task indexes some ``block`` codes and searches them for at most some
    ``chunk`` queries.  Codes travel, and are indexed, once per chunk of queries:
    once, for any number of queries up to ``chunk``, but where there are so few
    blocks that fewer than ``least_tasks`` tasks would work.
    """
    ship(codes.sparkSession)
    codes = materialize(codes.select("id", "code", "width"), "codes")
    queries = materialize(queries.select("id", "code", "width"), "queries")
    nb = max(1, -(-codes.count() // block))
    nc = max(-(-queries.count() // chunk), -(-least_tasks // nb))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = codes.select("width", deal(nb).alias("b"), every(nc).alias("c"), "id", "code", F.lit(False).alias("is_query"))
    asked = queries.select("width", every(nb).alias("b"), deal(nc).alias("c"), "id", "code", F.lit(True).alias("is_query"))
    found = rows.unionByName(asked).groupBy("width", "b", "c").applyInPandas(_search(k), "query_id long, id long, distance int")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")

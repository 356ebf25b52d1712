"""SimHash near-dedup whose links are Jaccard >= 0.8 of five-word shingle sets, all of them.

The links come in three steps, each verified by the exact Jaccard of whole texts:

1. *Fingerprints.*  The SimHash operator's fingerprints, over five-word shingles,
   are linked within 4 bits by its generalised pigeonhole index.
2. *Stars.*  Sets with Jaccard >= 0.8 share one of the first n - ceil(0.8 n) + 1
   shingles of each under any order of all shingles (prefix filter).  The star
   of such a key is the document with the fewest shingles of its own: of a
   group of edited copies the one they were made from.  Each document is
   compared with the best star of its keys that is not in its component yet,
   which joins most of what the fingerprints left apart (Jaccard 0.8 is some 10
   bits), at one pair a document.
3. *The rest.*  Of keys whose documents are still in several components, those
   outside the largest are compared with all documents of other components,
   each pair at the first key it shares.

So fingerprints and stars decide work and never results.  Pairs are ruled out
unread if their sizes, or the places of the shared key in both prefixes, do not
allow the overlap (the smaller set's key is among its first n - ceil(8/9 n) + 1),
and if counts of their shingles in 256 ranges of the hash bound it from above.
The order puts shingles that a sample of documents repeats last, the most
frequent at the end: common lines and passages are keys only of documents that
hold little else.  The sample decides work, too.

The driver sees at most ``most_common`` shingles of the sample.  Sets and
shingles stand for themselves by 64-bit hashes.

Edge cases: a null, empty or blank text is the empty set and a copy of any
other; fewer words than a shingle make one shingle; a very long text is hashed
whole; documents with equal ids are one node; a null doc_id is linked with
nothing and its component is null; an empty table gives an empty result; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release, ship, trimmed
from .components import connected_components
from .simhash import fingerprint, link_fingerprints, shingle_hashes

SHINGLE, SAMPLE, STRIPE, BITS = 5, 20_000, 1_000, 4
#: Jaccard >= 4 / 5, in whole numbers.
SHARE, OF = 4, 5


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of word shingles (A-Z lower-cased)."""
    return np.unique(shingle_hashes(text, shingle, seed))


def _print(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes())


def sketch(h: np.ndarray) -> bytes:
    """How many shingles of a set lie in each of 256 ranges of the hash; empty if a count has no byte."""
    n = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches do not rule Jaccard >= 0.8 out."""
    for b in batches:
        a, b_ = b.column(4).to_pylist(), b.column(5).to_pylist()
        known = np.array([bool(s and t) for s, t in zip(a, b_)], bool)
        x, y = (np.frombuffer(b"".join(s or bytes(256) for s in c), np.uint8).reshape(-1, 256) for c in (a, b_))
        most, x, y = (z.sum(axis=1, dtype=np.int64) for z in (np.minimum(x, y), x, y))
        keep = ~known | (most * OF >= (x + y - most) * SHARE)
        yield pa.RecordBatch.from_arrays(b.columns[:4], ["a", "b", "u", "v"]).filter(pa.array(keep))


def prefix(h: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of a set under which it meets every set of Jaccard >= 0.8."""
    n = len(h)
    if not n:
        return h
    seen = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        seen = np.where(common[at] == h, often[at], 0)
    return h[np.lexsort((h, seen))[: n - -(-SHARE * n // OF) + 1]]


def common_shingles(docs: DataFrame, shingle: int, sample: int = SAMPLE, most_common: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least three documents of the sample hold, and in how many."""
    step = max(1, docs.count() // sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(0)]
            h, n = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    rows = some.mapInArrow(trimmed(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 3")
    found = rows.orderBy(F.desc("n"), "h").limit(most_common).toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _fit(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
    """Sizes n and the places p of a shared key in both prefixes allow Jaccard >= 0.8.

    From the places on at most ``rest`` shingles can be shared; the overlap must
    be at least 4/9 of both sizes.  Exact for the first key that a pair shares,
    which is enough: later keys may be passed over.
    """
    rest = F.least(na - pa, nb - pb)
    return (na * OF >= nb * SHARE) & (nb * OF >= na * SHARE) & (rest * (SHARE + OF) >= (na + nb) * SHARE)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(u, v) of the pairs (a, b, u, v) of set prints and documents whose Jaccard is >= 0.8."""
    marks = reps.select("fp", "sketch")
    pairs = pairs.join(marks.select(F.col("fp").alias("a"), F.col("sketch").alias("_sa")), "a").join(marks.select(F.col("fp").alias("b"), F.col("sketch").alias("_sb")), "b")
    pairs = pairs.select("a", "b", "u", "v", "_sa", "_sb").mapInArrow(trimmed(_possible), "a long, b long, u long, v long")
    pairs = materialize(pairs, "near_pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(reps.select("fp", "rep"), "fp")
    ids = needed.select(F.col("rep").alias("_rep")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(0)]
            prints = np.fromiter(map(_print, sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["fp", "h"])

    if ids.count() <= 1_000_000:  # some 16 MB; texts then stay where they are
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"].cast("long") == ids["_rep"], "left_semi").select("text")
    sets = materialize(texts.mapInArrow(trimmed(run), "fp long, h array<long>"), "near_sets").dropDuplicates(["fp"])
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("h").alias("_ha")), "a").join(sets.select(F.col("fp").alias("b"), F.col("h").alias("_hb")), "b")
    same = F.size(F.array_intersect("_ha", "_hb"))
    links = both.filter(same * OF >= (F.size("_ha") + F.size("_hb") - same) * SHARE)
    return materialize(links.select("u", "v"), "near_links")


def _mixed(shared: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``shared`` with component ``c``, and only keys that hold several components."""
    if parts is None:
        placed = shared.withColumn("c", F.col("rep"))
    else:
        placed = shared.join(parts, shared["rep"] == parts["node"], "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")
    keys = placed.groupBy(F.col("key").alias("_k")).agg(F.min("c").alias("_a"), F.max("c").alias("_b")).filter("_a <> _b").select("_k")
    return placed.join(keys, placed["key"] == keys["_k"], "left_semi")


def _stars(shared: DataFrame) -> DataFrame:
    """One pair (a, b, u, v) for each document whose keys hold another component's star."""
    star = F.min(F.struct((-F.col("common")).alias("order"), "fp", "rep", "n", "pos", "c")).alias("_s")
    stars = shared.groupBy(F.col("key").alias("_k")).agg(star)
    met = shared.join(stars, shared["key"] == stars["_k"]).filter((F.col("c") != F.col("_s.c")) & _fit(F.col("n"), F.col("pos"), F.col("_s.n"), F.col("_s.pos")))
    return met.groupBy(F.col("fp").alias("b"), F.col("rep").alias("v")).agg(F.min("_s").alias("_s")).select(F.col("_s.fp").alias("a"), "b", F.col("_s.rep").alias("u"), "v")


def _first_keys(shared: DataFrame, most: int = 64) -> DataFrame:
    """Add ``keys``: the keys of the row's document in order, null if they are many.

    With them a pair is made at the first key it shares; where they are null it
    is made at each, and once after that.
    """
    own = shared.groupBy(F.col("fp").alias("_f")).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("_o"))
    own = own.select("_f", F.when(F.col("_n") <= most, F.transform("_o", lambda x: x["key"])).alias("keys"))
    return shared.join(own, shared["fp"] == own["_f"]).drop("_f")


def _across(placed: DataFrame) -> DataFrame:
    """(a, b, u, v): the pairs of a key's documents that are in different components.

    Documents outside the key's largest component meet all others; those inside
    it need not meet each other, so what a crowded key costs is how many are
    left over times how many there are.  The latter are dealt into stripes.
    """
    parts = placed.groupBy(F.col("key").alias("_k"), F.col("c").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    largest = parts.groupBy("_k").agg(F.max(F.struct("_n", "_c")).alias("_m")).select("_k", F.col("_m._c").alias("_major"))
    marked = placed.join(largest, placed["key"] == largest["_k"]).withColumn("_over", F.col("c") != F.col("_major")).drop("_k", "_major")
    marked = materialize(marked, "marked_keys")
    stripes = F.ceil(F.col("many") / STRIPE).cast("int")
    side = lambda fp, rep, x: [F.col("fp").alias(fp), F.col("rep").alias(rep), *[F.col(c).alias(f"_{c}{x}") for c in ("n", "pos", "c", "keys")]]
    left = marked.filter("_over").select("key", F.explode(F.sequence(F.lit(0), stripes - 1)).alias("stripe"), *side("a", "u", "a"))
    right = marked.select("key", F.pmod(F.xxhash64("fp"), stripes).cast("int").alias("stripe"), *side("b", "v", "b"), "_over")
    once = ~F.col("_over") | (F.col("a") < F.col("b"))
    apart = (F.col("_ca") != F.col("_cb")) & _fit(F.col("_na"), F.col("_posa"), F.col("_nb"), F.col("_posb"))
    first = F.coalesce(F.element_at(F.array_intersect("_keysa", "_keysb"), 1) == left["key"], F.lit(True))
    return left.join(right, (left["key"] == right["key"]) & (left["stripe"] == right["stripe"]) & once & apart & first).select("a", "b", "u", "v")


def near_components(docs: DataFrame, shingle: int = SHINGLE, turns: int = 1) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    common, often = common_shingles(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [shingle_hashes(t.as_py(), shingle) for t in b.column(1)]
            simhash = np.fromiter(map(fingerprint, every), np.uint64, len(every)).view(np.int64)
            sets = [np.unique(h) for h in every]
            prints = np.fromiter(map(_print, sets), np.uint64, len(sets)).view(np.int64)
            keys = pa.array([prefix(h, common, often).view(np.int64) for h in sets], pa.list_(pa.int64()))
            columns = [b.column(0), pa.array(prints), pa.array(simhash), pa.array([len(h) for h in sets], pa.int32()), pa.array(map(sketch, sets), pa.binary()), keys]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "simhash", "n", "sketch", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, fp long, simhash long, n int, sketch binary, keys array<long>")
    rows = materialize(rows, "shingle_keys")
    prints = materialize(rows.select("doc_id", "fp"), "set_prints")
    fields = ["doc_id", "simhash", "n", "sketch", "keys"]
    best = rows.dropna(subset=["doc_id"]).groupBy("fp").agg(F.min(F.struct(*fields)).alias("s"))
    reps = materialize(best.select("fp", F.col("s.doc_id").alias("rep"), *[F.col(f"s.{c}").alias(c) for c in fields[1:]]), "representatives")
    release(rows)
    # Sets whose fingerprints are within some bits.  Of equal fingerprints the
    # smallest document stands for all, linked with each of them.
    by_print = materialize(reps.groupBy("simhash").agg(F.min("rep").alias("top")), "simhashes")
    close = link_fingerprints(by_print.select(F.col("simhash").alias("fp"), F.col("top").alias("rep")), BITS)
    same = reps.join(by_print, "simhash").filter("rep <> top").select(F.col("top").alias("u"), F.col("rep").alias("v"))
    close = close.unionByName(same)
    ids = reps.select("rep", "fp")
    close = close.join(ids.select(F.col("rep").alias("u"), F.col("fp").alias("a")), "u").join(ids.select(F.col("rep").alias("v"), F.col("fp").alias("b")), "v")
    links = _verified(close.select("a", "b", "u", "v"), reps, docs, shingle)
    # Keys that several sets share.  Counts are a table of their own, so that a
    # key of any share of the sets can be split.  ``common``: which part of its
    # prefix a document shares with others.
    keys = reps.select("fp", "rep", "n", F.size("keys").alias("_size"), F.posexplode("keys").alias("pos", "key"))
    many = materialize(keys.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "many_keys")
    met = keys.join(many, keys["key"] == many["_k"]).drop("_k")
    met = met.withColumn("common", F.count(F.lit(1)).over(Window.partitionBy("fp")) / F.col("_size"))
    shared = materialize(met.select("key", "many", "fp", "rep", "n", "pos", "common"), "shared_keys")
    for _ in range(turns):
        left = materialize(_mixed(shared, connected_components(links)), "mixed_keys")
        links = materialize(links.unionByName(_verified(_stars(left), reps, docs, shingle)), "near_links")
        release(shared)
        shared = left.drop("c")
    placed = materialize(_first_keys(_mixed(shared, connected_components(links))), "mixed_keys")
    pairs = _across(placed).distinct()
    links = links.unionByName(_verified(pairs, reps, docs, shingle))
    # Documents that repeat an id with other texts tie their sets together.
    again = prints.dropna().groupBy("doc_id").agg(F.min("fp").alias("_a"), F.max("fp").alias("_b")).filter("_a <> _b").select("doc_id")
    again = prints.join(again, "doc_id").join(reps.select("fp", "rep"), "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    parts = connected_components(links.unionByName(again))
    known = reps.join(parts, reps["rep"] == parts["node"], "left").select(F.col("fp").alias("_f"), F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(known, prints["fp"] == known["_f"], "left")
    out = materialize(out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), "components")
    release(prints, reps, shared, placed, many)
    return out

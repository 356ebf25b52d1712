"""Mix sources to target weights by a low-discrepancy schedule of token blocks.

``source_targets`` gives each source its share of the mix (weights, stopped at
a cap of epochs, the excess shared again).  ``mix`` lays each source's shuffled
documents end to end as a stream of words, cuts the stream into blocks of equal
size, maps golden-ratio points through the cumulative weights to a schedule of
slots, ranks the slots per source and joins the k-th slot of a source with the
k-th block of its stream (starting over for each epoch).  The last block a
source needs is cut so that it meets its target to within a word.  Slots in
order are the mix: any stretch of them holds the sources in their proportions.

There may be many sources and one may hold most rows: sources are ranked within
ranges of their names, levels are found from sums, and streams are prefix sums
over ranges of a hash.  The driver sees a few sums for each range of 100,000
sources.

Edge cases: a null text has size 0 and is never taken from; a null source is a
source of its own, ordered last; documents with equal or null ids are taken from
one by one, repeated rows sharing evenly what their copies give; a very long
text spans as many blocks as it needs; documents that tie in the shuffle go by
id and size; an empty table gives an empty mix; other columns play no part, and
those named like the result's are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, in_order, materialize, prefix_sums, running_offsets

#: Fractional parts of the golden ratio and of 2**20 times it: n * phi mod 1 is
#: then exact to about 1e-12 for any schedule length in use.
PHI = (math.sqrt(5) - 1) / 2
PHI_HIGH = math.fmod(PHI * 2**20, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size) -> with ``position``, ``weight`` and ``target``.

    The shares solve sum(min(epochs * size, level * weight)) = share * total.
    Starting from the level without caps, each round shares again what the
    sources above their cap leave, until none is above.
    """
    name = F.asc_nulls_last("source")
    df = prefix_sums(in_order(sizes, name, "mix-sources"), name, F.lit(1), "position").withColumn("position", F.col("position") + 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    df = materialize(df.withColumn("weight", w).withColumn("_cap", F.col("source_size") * float(epochs)), "mix-weights")
    total = share * (df.agg(F.sum("source_size")).first()[0] or 0)
    level, settled = 0.0, -1
    while True:
        over = F.col("_cap") < F.lit(level) * F.col("weight")
        capped, weight, n = df.agg(F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == settled or not weight:
            break
        level, settled = (total - capped) / weight, n
    target = F.col("_cap") if not weight else F.least(F.col("_cap"), F.lit(level) * F.col("weight"))
    return df.select("source", "source_size", "position", "weight", target.alias("target"), "_part")


def schedule(shares: DataFrame, block_words: int) -> DataFrame:
    """Slots (``position`` of the source, ``slot``, ``rank`` from 0) for the shares.

    Point n of the golden-ratio sequence picks the source whose interval of
    the cumulative targets holds it.  Slots beyond what a source needs are
    left out, and those that a source still lacks follow at the end.
    """
    spark = shares.sparkSession
    # Whole epochs take all blocks of a source, the short last one included.
    want, whole = F.floor("target").cast("long"), F.ceil(F.col("source_size") / block_words)
    turns = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0)
    needs = shares.withColumn("needs", (turns * whole + F.ceil((want - turns * F.col("source_size")) / block_words)).cast("long"))
    parts = prefix_sums(needs.filter("needs > 0"), F.col("position"), F.col("needs"), "_first")
    total, sources = parts.agg(F.sum("needs"), F.count(F.lit(1))).first()  # two numbers
    total = total or 0
    parts = parts.select("position", "needs", (F.col("_first") / float(max(1, total))).alias("_low"), ((F.col("_first") + F.col("needs")) / float(max(1, total))).alias("_high"))
    n = F.col("id") + 1
    point = F.expr(f"({PHI_HIGH!r}D * floor((id + 1) / 1048576) + {PHI!r}D * ((id + 1) % 1048576)) % 1.0D")
    # Intervals are spread over the cells of a grid that they meet, so the lookup
    # is an equi-join on the cell; there are some cells for every source.
    cells = max(4_096, 4 * sources)
    slots = spark.range(total).select(n.alias("slot"), point.alias("_p")).withColumn("_cell", F.floor(F.col("_p") * cells))
    spread = parts.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") * cells), F.least(F.lit(cells), F.floor(F.col("_high") * cells)))))
    found = slots.join(spread, "_cell").filter("_p >= _low AND _p < _high").select("position", "slot", "needs")
    found = running_offsets(found, "position", [_spread_slot(total), F.col("slot")], F.lit(1), "rank").filter("rank < needs")
    found = materialize(found.select("position", "slot", "rank"), "mix-slots")
    have = found.groupBy("position").agg(F.count(F.lit(1)).alias("_have"))
    lacking = parts.join(have, "position", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter("_have < needs")
    extra = lacking.select("position", F.explode(F.sequence("_have", F.col("needs") - 1)).alias("rank"))
    extra = extra.withColumn("slot", F.lit(total) + 1 + F.col("rank") * 1_000_003 + F.col("position"))
    return found.unionByName(extra.select("position", "slot", "rank"))


def _spread_slot(total: int) -> Column:
    """Slot numbers stretched over the range of a long, in order."""
    return ((F.col("slot") / float(max(1, total)) - 0.5) * 2.0**63 * 1.999).cast("long")


def shuffled_stream(sized: DataFrame, seed: int) -> DataFrame:
    """Each source's documents end to end in a seeded order: ``at`` is where one begins."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return running_offsets(sized, "position", [h, F.col("doc_id"), F.col("size")], F.col("size"), "at")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, block_words: int = 4_096, seed: int = 8) -> tuple[DataFrame, DataFrame]:
    """The mix as (documents, pieces).

    documents: doc_id, source, size, source_size, target of every row.
    pieces: doc_id, slot, epoch, first word, words: what each slot of the
    schedule takes of which document, in words from the document's start.
    """
    docs = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = materialize(source_targets(sizes, weights, share, epochs), "mix-targets")
    s = shares.select(F.col("source").alias("_s"), "position", "source_size", "target")
    # A narrow table of its own: it is read several times below.
    placed = materialize(docs.join(s, docs["source"].eqNullSafe(s["_s"]), "left").drop("_s"), "mix-placed")
    stream = shuffled_stream(placed.filter("size > 0"), seed)
    blocks = stream.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))))
    slots = schedule(shares, block_words)
    per = shares.select("position", F.ceil(F.col("source_size") / block_words).cast("long").alias("_blocks"), F.floor("target").cast("long").alias("_want"), F.col("source_size").alias("_size"))
    slots = slots.join(per, "position")
    # Slot k takes block k mod blocks in epoch k div blocks; what it may take
    # ends where the source's target does.  A slot of a short last block takes
    # less, so words before slot k are counted by epoch.
    slots = slots.withColumn("epoch", F.floor(F.col("rank") / F.col("_blocks"))).withColumn("block", F.col("rank") % F.col("_blocks"))
    slots = slots.withColumn("_left", F.col("_want") - F.col("epoch") * F.col("_size")).select("position", "block", "slot", "epoch", "_left")
    met = blocks.select("doc_id", "size", "at", "position", "block").join(slots, ["position", "block"])
    begin = F.greatest(F.col("at"), F.col("block") * block_words)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words, F.col("_left"))
    pieces = met.withColumn("_from", begin).withColumn("_to", end).filter("_to > _from")
    pieces = pieces.select("doc_id", "size", "position", "slot", "epoch", (F.col("_from") - F.col("at")).alias("first"), (F.col("_to") - F.col("_from")).alias("words"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "position"), pieces


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: size, source_size, target, ``taken`` (the words in the mix),
    the first slot of the mix that holds it and how many slots do."""
    every, pieces = mix(docs, **options)
    got = pieces.groupBy(F.col("doc_id").alias("_d"), F.col("position").alias("_p"), F.col("size").alias("_z"))
    got = got.agg(F.sum("words").alias("_t"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("slots"))
    # Rows that repeat id, source and size share what was taken of them evenly.
    same = every.groupBy("doc_id", "position", "size", "source", "source_size", "target").agg(F.count(F.lit(1)).alias("_n"))
    out = same.join(got, same["doc_id"].eqNullSafe(got["_d"]) & (same["position"] == got["_p"]) & (same["size"] == got["_z"]), "left")
    out = out.withColumn("_t", F.coalesce("_t", F.lit(0))).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    each = F.floor(F.col("_t") / F.col("_n")) + (F.col("_k") <= F.col("_t") % F.col("_n")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", each.cast("long").alias("taken"), "first_slot", F.coalesce("slots", F.lit(0)).alias("slots"))

"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept; all but the last return the
columns of ``documents``.  ``run`` writes every stage as a table in the shared
folder and reads it back, so a lost executor never reaches behind a stage.

A stage keeps null doc_ids, null texts and further columns as they are (column
names of the operators may be among them); repeated rows of one id count as one
document in the second stage, which keeps one of them; very long texts are
worked on whole; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import mixing, packing, simhash, substring_dedup, toxicity
from folioscope.llm.common import WORD, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    whole = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest"))
    scored = toxicity.score_toxicity(whole, table(spark, sf_dir, "labels"))
    return _unfold(scored.filter("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard >= 0.8 of five-word shingles the smallest id stays (one row of it).

    SimHash fingerprints of these shingles find most links; what lies further
    apart than their index reaches is found by shared shingles, so none is lost.
    """
    found = simhash.near_duplicates(docs)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND doc_id IS NOT NULL").limit(1).count()
    if not again:  # no id repeats: nothing more to choose
        return kept
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeated passages cover go; documents stay."""
    whole = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest"))
    left = substring_dedup.remove_repeats(whole, carry=["_rest"]).withColumnRenamed("kept", "text")
    return _unfold(left, docs, text_changed=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per document and epoch it is taken in,
    in the order of the schedule's slots, the last document of a source cut where
    the target is met."""
    every, pieces = mixing.mix(docs)
    taken = pieces.groupBy(F.col("doc_id").alias("_d"), F.col("position").alias("_p"), F.col("size").alias("_z"), "epoch").agg(F.sum("words").alias("_t"), F.min("slot").alias("_slot"))
    same = every.groupBy(F.col("doc_id").alias("_d1"), F.col("position").alias("_p1"), F.col("size").alias("_z1"), F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    taken = taken.join(same, F.col("_d").eqNullSafe(F.col("_d1")) & (F.col("_p") == F.col("_p1")) & (F.col("_z") == F.col("_z1")))
    # Narrow, and read twice: to find the ranges of slots, then to deal texts to them.
    taken = materialize(taken.select("_d", "_source", "_z", "_slot", F.ceil(F.col("_t") / F.col("_n")).cast("int").alias("_take")), "mix-taken")
    whole = docs.select("doc_id", "text", "source", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest"), mixing.word_count(F.col("text")).alias("_size"))
    on = whole["doc_id"].eqNullSafe(taken["_d"]) & whole["source"].eqNullSafe(taken["_source"]) & (whole["_size"] == taken["_z"])
    met = whole.join(taken, on)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_take")), " ")
    met = met.withColumn("text", F.when(F.col("_take") < F.col("_size"), cut).otherwise(F.col("text")))
    return _unfold(met.orderBy("_slot", "doc_id"), docs, text_changed=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their place in sequences of 2,048 ids."""
    return packing.pack(docs)


def _unfold(df: DataFrame, docs: DataFrame, text_changed: bool = False) -> DataFrame:
    """Back to the columns of ``docs``; n_chars follows a changed text."""
    cols = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    cols |= {c: F.col("_rest")[c] for c in docs.columns if c not in cols}
    if text_changed and "n_chars" in cols:
        cols["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return df.select(*[cols[c].alias(c) for c in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Token ids and model scores have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The pipeline, stage by stage, and as a whole."""

import itertools
import random
import zlib
from collections import Counter

import corpus_pipeline
from folioscope.llm import mixing, packing, toxicity
from folioscope.llm.common import materialize

from .helpers import DOC_SCHEMA, awkward, documents, words
from .test_documents import brute_components, brute_repeats, brute_targets
from .test_near_copies import edited, jaccard


def test_stages_keep_the_columns(spark, tmp_path):
    docs = documents(spark, [r for r in awkward() if r[0] != 41])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    left = docs
    for (name, stage) in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, str(tmp_path))
        assert out.columns == docs.columns
        rows, before = out.collect(), left.collect()
        if name == "simhash_near_dedup":
            assert sorted(r["doc_id"] for r in rows) == sorted({r["doc_id"] for r in rows})
            assert not {30, 31, 32, 33, 34, 35} & {r["doc_id"] for r in rows}
        if name == "substring_dedup":
            assert len(rows) == len(before)
        if name == "source_mix":
            want = {r["source"]: r["target"] for r in mixing.taken_words(left).collect()}
            got: dict = {}
            for r in rows:
                got[r["source"]] = got.get(r["source"], 0) + len((r["text"] or "").split())
            assert all(abs(got.get(s, 0) - t) <= 1 for s, t in want.items())
        left = spark.createDataFrame(rows, DOC_SCHEMA)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and whole.count() > 0


def test_run_equals_a_slow_version(spark, tmp_path):
    """Every stage again by brute force, each on what the one before kept."""
    rng = random.Random(6)
    rows = [r for r in awkward(3) if r[0] not in (40, 41)]
    rows += [(100 + i, " ".join(words(rng, 30)) + (" you vile v1le wretch " if i % 3 == 0 else " fine ") + " ".join(words(rng, 9)), rng.choice(["a", "b"])) for i in range(120)]
    base = " ".join(words(rng, 150, 9_000))
    rows += [(300 + i, edited(rng, base, 1), "b") for i in range(4)]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    text = {i: t for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    # Toxicity: the model's score of each text.
    score = toxicity.train(docs, marks).scorer()
    left = sorted(i for i in text if score(text[i]) < 0.5)
    assert 30 < len(text) - len(left) < 50
    # Near copies: the smallest of each component stays.
    links = [(a, b) for a in left for b in left if a < b and jaccard(text[a], text[b]) >= 0.8]
    component = brute_components(left, links)
    left = [i for i in left if component[i] == i]
    assert not {301, 302, 303, 31, 32} & set(left)
    # Repeats.
    text |= {i: kept for i, (_, _, kept) in zip(left, brute_repeats([text[i] for i in left]))}
    # The mix: targets, and every row a beginning of its document.
    size = {i: len(text[i].split(" ")) if text[i] else 0 for i in left}
    sizes: dict = {}
    for i in left:
        sizes[source[i]] = sizes.get(source[i], 0) + size[i]
    targets = brute_targets(sizes)
    mixed = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        mixed = materialize(stage(spark, mixed, str(tmp_path)), "slow")
    mixed = mixed.collect()
    taken: dict = {}
    for r in mixed:
        assert r["doc_id"] in size and text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split(" "))
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in targets.items())
    assert all(sum(r["doc_id"] == i for r in mixed) <= 2 for i in left)
    # Packing: every piece of every row, in sequences without gaps.
    enc = packing.WordEncoder()
    pieces = Counter()
    for r in mixed:
        ids = enc._whole(r["text"]) + bytes(4)
        pieces.update((r["doc_id"], k, 2048 * k, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])) for k, at in enumerate(range(0, len(ids), 8192)))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in whole) == pieces
    by: dict = {}
    for r in whole:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == list(itertools.accumulate([0, *(n for _, n in sorted(parts))]))[:-1] and sum(n for _, n in parts) <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = documents(spark, awkward())
    for c in ("score", "kept", "n_words", "size", "_rest", "_take", "_size", "_slot", "_d", "_d1", "d1", "_gone", "_n", "keys", "component_id", "predicted", "position", "epoch"):
        docs = docs.withColumn(c, F.lit(c))
    spark.createDataFrame([(7, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.filter("score = 'score'").count() == out.count() > 0

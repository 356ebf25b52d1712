"""The stored index against scores worked out text by text, and what its bounds save."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.operators import inverted, retrieval
from folioscope.operators.inverted import InvertedIndex

TOKEN = re.compile(r"[a-zA-Z0-9]+(?:[.,][a-zA-Z0-9]+)*")


def tokens(text):
    return TOKEN.findall((text or "").lower())


def slow_bm25(chunks, questions):
    held = {c: Counter(tokens(t)) for c, t in chunks.items()}
    n, mean = len(chunks), sum(sum(h.values()) for h in held.values()) / len(chunks)
    df = Counter(t for h in held.values() for t in h)
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for q, text in questions.items():
        for c, h in held.items():
            met = [t for t in tokens(text) if t in h]
            if met:
                size = sum(h.values())
                out[q, c] = sum((idf[t] if idf[t] >= 0 else low) * h[t] * 2.5 / (h[t] + 1.5 * (0.25 + 0.75 * size / mean)) for t in met)
    return out


def corpus(n=300, seed=1):
    """Chunks about subjects that follow one another, all with some common words; nulls and blanks among them."""
    rng = random.Random(seed)
    chunks = {}
    for i in range(n):
        subject = [f"s{i // 20}x{j}" for j in range(8)]
        chunks[i * 3] = " ".join(rng.choice(subject + ["common", "word", f"n{rng.randrange(200)}"]) for _ in range(rng.randrange(5, 40)))
    chunks[2], chunks[5], chunks[-7] = None, "", "Common! s1x1, 3.5"
    return chunks


def frames(spark, chunks, questions):
    return spark.createDataFrame(list(chunks.items()), "chunk_id long, text string").repartition(3), spark.createDataFrame(list(questions.items()), "q_id long, question string")


QUESTIONS = {1: "common s3x1 s3x2 s3x1", 2: "s9x0 s9x1 s9x2 word", 3: "nothing of it", 4: "", 5: "common word", 6: "S1X1 3.5 n17"}


@pytest.mark.parametrize(("width", "shelves", "sent"), [(16, 3, 1_000_000), (16, 3, 0), (4_096, 16, 0)])
def test_scores_and_best_chunks(spark, tmp_path, monkeypatch, width, shelves, sent):
    monkeypatch.setattr(inverted, "MOST_SENT", sent)
    monkeypatch.setattr(inverted, "CHUNKS_AT_ONCE", 7)
    chunks = corpus()
    table, asked = frames(spark, chunks, QUESTIONS)
    InvertedIndex.build(table, str(tmp_path), width, shelves)
    index = InvertedIndex.open(spark, str(tmp_path))
    want = slow_bm25(chunks, QUESTIONS)
    got = {(r["q_id"], r["chunk_id"]): r["bm25"] for r in retrieval.bm25(table, asked, index).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    share = {(r["q_id"], r["chunk_id"]): r["keyword"] for r in retrieval.keyword_overlap(table, asked, index).collect()}
    assert share == {(q, c): pytest.approx(len(set(tokens(QUESTIONS[q])) & set(tokens(chunks[c]))) / len(set(tokens(QUESTIONS[q])))) for q, c in want}
    for k in (1, 5):
        best = {q: sorted((-round(v, 6), c) for (p, c), v in want.items() if p == q)[:k] for q in QUESTIONS}
        found = {}
        for r in sorted(index.best(asked, k, probe=2).collect(), key=lambda r: r["rank"]):
            found.setdefault(r["q_id"], []).append((-r["bm25"], r["chunk_id"]))
        assert {q: [c for _, c in x] for q, x in found.items()} == {q: [c for _, c in x] for q, x in best.items() if x}
        assert [s for q in found for s, _ in found[q]] == pytest.approx([s for q in found for s, _ in best[q]], abs=1e-6)


def test_bounds_hold_and_spare_ranges(spark, tmp_path):
    chunks = corpus()
    table, asked = frames(spark, chunks, QUESTIONS)
    index = InvertedIndex.build(table, str(tmp_path), width=16, shelves=4)
    weighed = index.weighed(asked)
    bound = {(r["q_id"], r["range"]): r["bound"] for r in index.bounds(weighed).collect()}
    for (q, c), v in slow_bm25(chunks, QUESTIONS).items():
        assert v <= bound[q, int(c / 16)] + 1e-9
    first, _, rest = (x.collect() for x in index.opened(weighed.filter("q_id IN (1, 2)").collect(), k=3, probe=2))
    of = lambda rows, q: sum(r["q_id"] == q for r in rows)
    for q in (1, 2):  # the subject lies in few ranges, the common word in all
        assert of(first, q) == 2 and of(first, q) + of(rest, q) <= 10 < sum(p == q for p, _ in bound)
    assert not {(r["q_id"], r["range"]) for r in first} & {(r["q_id"], r["range"]) for r in rest}


def test_index_skips_texts_and_prunes_shelves(spark, tmp_path):
    chunks = corpus(60)
    table, asked = frames(spark, chunks, QUESTIONS)
    index = InvertedIndex.build(table, str(tmp_path), width=16, shelves=4)
    plan = index.bm25(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "tf#" in plan
    assert {r["shelf"] for r in index.postings().select("shelf").distinct().collect()} <= set(range(4))


def test_index_of_nothing_and_of_chunks_without_ids(spark, tmp_path):
    table, asked = frames(spark, {1: None, 2: "", None: "common word"}, QUESTIONS)
    index = InvertedIndex.build(table, f"{tmp_path}/a")
    assert (index.n_chunks, index.mean_length) == (2, 0.0) and index.best(asked, 3).collect() == [] and index.terms().count() == 0
    empty = InvertedIndex.build(table.limit(0), f"{tmp_path}/b")
    assert empty.n_chunks == 0 and empty.bm25(asked).collect() == [] and empty.keyword(asked).collect() == []
    assert InvertedIndex.build(table.limit(0), f"{tmp_path}/b").n_chunks == 0  # again, over what is there


def test_terms_in_most_chunks_weigh_a_part_of_the_mean(spark, tmp_path):
    table, _ = frames(spark, corpus(), QUESTIONS)
    terms = {r["term"]: r["idf"] for r in InvertedIndex.build(table, str(tmp_path)).terms().collect()}
    assert 0 < terms["common"] < min(v for t, v in terms.items() if t not in ("common", "word"))
    assert InvertedIndex.open(spark, str(tmp_path)).terms().agg(F.count_distinct("term")).first()[0] == len(terms)


def test_a_task_of_postings_does_not_grow(spark, tmp_path, monkeypatch):
    """Each file holds one shelf of some ranges, however many chunks there are, and terms lie in order in it."""
    monkeypatch.setattr(inverted, "TOKENS_AT_ONCE", 50)
    monkeypatch.setattr(inverted, "RANGES_A_TASK", 2)
    chunks = {i: f"w{i % 7} w{i % 11} w{i % 7}, W{i} 3.5" for i in range(400)}
    df = spark.createDataFrame(list(chunks.items()), "chunk_id long, text string").repartition(3)
    index = InvertedIndex.build(df, str(tmp_path), width=20, shelves=3)
    rows = index.postings().select("*", F.input_file_name().alias("file")).collect()
    assert {(r["term"], r["chunk_id"], r["tf"], r["len"]) for r in rows} == {(t, c, n, len(tokens(x))) for c, x in chunks.items() for t, n in Counter(tokens(x)).items()}
    of_file = {}
    for r in rows:
        of_file.setdefault(r["file"], set()).add((r["shelf"], r["range"] // 2))
    assert all(len(x) == 1 for x in of_file.values()) and len(of_file) == 3 * 10


def test_keyword_pairs_are_not_shuffled(spark, tmp_path):
    table, asked = frames(spark, corpus(), QUESTIONS)
    index = InvertedIndex.build(table, str(tmp_path))
    plan = index.keyword(asked)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(near" in plan and "hashpartitioning(q_id" not in plan
    assert index.keyword(asked.filter("question = ''")).collect() == []

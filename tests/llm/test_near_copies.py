"""The pipeline's near-copy stage against brute force over all pairs."""

import random

import corpus_pipeline
import pytest
from folioscope.llm import near_copies

from .helpers import awkward, documents, words
from .test_documents import brute_components


def jaccard(a, b):
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_stage_drops_what_is_similar_from_four_fifths_on(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 200, 10_000)), "a") for i in range(20)]
    rows += [(100 + i, edited(rng, rows[i][1], 4 if i % 2 else 6), "a") for i in range(20)]
    tail = " ".join(words(rng, 46, 10_000))
    rows += [(200, rows[0][1] + " " + tail, "a"), (201, rows[1][1] + " " + tail + " u v w x y", "a")]  # 196 of 242, 196 of 247
    near = {i for i, t, _ in rows if any(j < i and jaccard(t, u) >= 0.8 for j, u, _ in rows)}
    assert 200 in near and 201 not in near and len(near) > 8
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows} - near


@pytest.mark.parametrize(("turns", "stripe", "sample"), [(1, 1_000, 20_000), (0, 3, 10), (2, 2, 20_000)])
def test_components_equal_brute_force(spark, monkeypatch, turns, stripe, sample):
    monkeypatch.setattr(near_copies, "STRIPE", stripe)
    monkeypatch.setattr(near_copies.common_shingles, "__defaults__", (sample, 500_000))
    rng = random.Random(3)
    rows = awkward() + [(None, "one", "a")]
    line, base = " ".join(words(rng, 30)), " ".join(words(rng, 90, 5_000))
    rows += [(1000 + i, line + " " + " ".join(words(rng, rng.randrange(3, 9))), "a") for i in range(40)]
    rows += [(2000 + i, edited(rng, base, rng.randrange(3)), "a") for i in range(40)]
    links = [(a, b) for a, t, _ in rows for b, u, _ in rows if a is not None and b is not None and a < b and jaccard(t, u) >= 0.8]
    want = brute_components({r[0] for r in rows if r[0] is not None}, links)
    got = near_copies.near_components(documents(spark, rows), turns=turns).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {*want.items(), (None, None)}


def test_near_copies_of_nothing(spark):
    assert near_copies.near_components(documents(spark, [])).count() == 0

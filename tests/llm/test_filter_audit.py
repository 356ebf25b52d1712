"""The bitmap index against counting every document in every order."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from folioscope.llm import filter_audit as fa

from .helpers import awkward, documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fails(text, copy):
    w = WORD.findall(text)
    upper = sum("A" <= c <= "Z" for c in text)
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * upper > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}


def slow_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    first: dict = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    docs = [(lang or "", i, slow_fails(t or "", i is not None and first[t or ""] < i)) for i, t, lang in rows]
    out = {}
    for part in {p for p, _, _ in docs}:
        own = [(i, f) for p, i, f in docs if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = own
            for k, x in enumerate(o):
                lost = [(i, f) for i, f in left if f[x]]
                after = [(i, f) for i, f in left if not f[x]]
                failing = [f for _, f in own if f[x]]
                out[part, "".join(o), k + 1] = [len(after), len(lost), len(failing) - len(lost), sum(sum(f.values()) == 1 for f in failing), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost), x]
                shapley[x] += len(lost)
                left = after
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def table():
    rng = random.Random(4)
    rows = [(i, t, random.Random(str(i)).choice(["en", "de", None, ""])) for i, t, _ in awkward()]
    for i in range(100, 160):
        text = " ".join(words(rng, rng.choice([50, 199, 200, 201, 400]), rng.choice([5, 5_000])))
        rows.append((i, text + rng.choice(["", " UPPER CASE", " 100 % #1 |", " a & b"]), rng.choice(["en", "de", "fr"])))
    rows += [(i + 100, t, "en") for i, t, _ in rows[-20:]] + [(None, rows[-1][1], "en"), (None, None, None), (5, "all but a copy of A", "xx")]
    return rows


LABELS = [(i, q, x) for i, q, x in ((k, k % 2, k % 3 == 0) for k in range(0, 260, 3))] + [(6, 0, 1), (6, 1, 0), (None, 1, 1), (9, None, None)]


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, "x") for i, t, p in rows], "doc_id long, text string, lang string, part string")
    return docs, spark.createDataFrame([(i, q, None if x is None else int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("block", [1 << 16, 16])
def test_audit_matches_counting(spark, monkeypatch, block):
    monkeypatch.setattr(fa, "BLOCK_ROWS", block)
    monkeypatch.setattr(fa, "MOST_PARTS", 2)
    rows = table()
    docs, labels = frames(spark, rows, LABELS)
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in fa.audit(docs.repartition(3), labels).collect()}
    assert found == slow_audit(rows, LABELS) and len(found) == 600 * len({p or "" for _, _, p in rows})


def test_failures_of_each_filter():
    long = " ".join(f"w{i}" for i in range(200))
    assert fa.failures(long.encode()) == 0
    assert fa.failures(b"") == 1 and fa.failures(" \n\x0b".encode()) == 1
    assert fa.failures(long.rpartition(" ")[0].encode()) == 1
    assert fa.failures(("a b c d e " * 20 * 4).encode()) == 2
    assert len(long) == 889  # 28 of 918 letters are over three in a hundred, 27 of 917 are not
    assert fa.failures((long + " " + "W" * 27).encode()) == 0 and fa.failures((long + " " + "W" * 28).encode()) == 0b0100
    assert fa.failures((long + " $").encode()) == 0b1000
    spaced = " ".join(["a b"] * 3)  # a no-break space is part of a word
    assert fa.failures(spaced.encode()) & 1 and len(spaced.encode().split()) == 3


def test_bitmap_counts_of_padded_parts():
    rng = np.random.default_rng(1)
    for n, parts in ((1, 1), (9, 2), (200, 7), (1_000, 900)):
        part = np.concatenate([np.arange(min(n, parts)), rng.integers(0, min(n, parts), n - min(n, parts))])
        rng.shuffle(part)
        fails, marks = rng.integers(0, 32, n), rng.integers(0, 4, n)
        got = fa.Bitmap(part, fails, marks).survivors()
        for s in range(32):
            alive = (fails & s) == 0
            for j, kind in enumerate((np.ones(n, bool), marks & 1 > 0, marks & 2 > 0)):
                assert (got[:, s, j] == np.bincount(part[alive & kind], minlength=part.max() + 1)).all()


def test_audit_of_nothing_and_of_one_hot_group(spark):
    docs, labels = frames(spark, [], [])
    assert fa.audit(docs, labels).collect() == []
    rows = [(i, "the same text", "en") for i in range(500)]
    docs, labels = frames(spark, rows, [])
    last = fa.audit(docs.repartition(5), labels).filter("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r["kept"], r["removed"], r["unique_fails"]) for r in last] == [(1, 499, 0)]

"""Piecewise fingerprints against a slow version, and properties that edits leave."""

import hashlib
import random

import pytest

from folioscope.llm import context_hash as ch

from .helpers import awkward, documents, words

M32 = 2**32 - 1
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def slow_hashes(data):
    """Polynomial hash of the eight bytes up to each byte, then mixed."""
    out = []
    for i in range(len(data)):
        h = 0
        for back in range(8):
            byte = data[i - back] if i >= back else 0
            weight = pow(0x9E3779B1, back, 2**32) if i - back >= -7 else 0
            h = (h + (byte + 1) * weight) & M32
        # Zeros stand before the text, seven of them.
        h ^= h >> 15
        h = h * 0x85EBCA6B & M32
        h ^= h >> 13
        out.append(h)
    return out


def slow_signature(data, k):
    out, total, is_open = "", 0, False
    for h in slow_hashes(data):
        total, is_open = (total + ((h ^ h >> 7) * 0x9E3779B1 & M32)) & M32, True
        if h & 2**k - 1 == 2**k - 1:
            out, total, is_open = out + LETTERS[(total * 0x85EBCA6B & M32) >> 26], 0, False
    if is_open:
        out += LETTERS[(total * 0x85EBCA6B & M32) >> 26]
    return "".join(c for i, c in enumerate(out) if out[max(0, i - 3) : i] != c * 3)


def slow_fingerprint(text):
    data = text.encode()
    k = 0
    while len(data) > 48 * 2**k:
        k += 1
    while len(slow_signature(data, k)) > 64 or len(slow_signature(data, k + 1)) > 64:
        k += 1
    return f"{k}:{slow_signature(data, k)}:{slow_signature(data, k + 1)}"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_likeness(f, g):
    if f == g:
        return 1.0
    (j, a, a2), (k, b, b2) = f.split(":"), g.split(":")
    best = 0.0
    for n, x in ((int(j), a), (int(j) + 1, a2)):
        for m, y in ((int(k), b), (int(k) + 1, b2)):
            if n == m and x and y and abs(int(j) - int(k)) <= 1:
                run = max(1, min(4, 3 * min(len(x), len(y)) // 4))
                if any(x[i : i + run] in y for i in range(len(x) - run + 1)):
                    best = max(best, 1 - slow_distance(x, y) / max(len(x), len(y)))
    return best


def texts(n=60):
    rng = random.Random(5)
    out = ["", "a", "ab", "one two", "é" * 50, "x" * 3_000, "ab " * 900, "\x00\x7f" * 30]
    return out + [" ".join(words(rng, rng.randrange(1, 400))) for _ in range(n)]


def test_fingerprints_equal_a_slow_version():
    for t in texts():
        assert ch.fingerprint(t.encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("size", [7, 64, 1_000])
def test_slices_do_not_show(monkeypatch, size):
    whole = [ch.fingerprint(t.encode()) for t in texts()]
    monkeypatch.setattr(ch, "SLICE", size)
    assert [ch.fingerprint(t.encode()) for t in texts()] == whole


def test_edit_distances_equal_the_table():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 5, 63, 64])))
    a, b = [word() for _ in range(300)], [word() for _ in range(300)]
    assert ch.edit_distances(a, b).tolist() == [slow_distance(x, y) for x, y in zip(a, b)]


def test_likeness_of_edited_and_unrelated_texts():
    rng = random.Random(3)
    base = [" ".join(words(rng, 600, 10_000)) for _ in range(100)]
    prints = [ch.fingerprint(t.encode()) for t in base]
    inserted = [ch.fingerprint((t[:900] + " some more words " + t[900:]).encode()) for t in base]
    cut = [ch.fingerprint(t[: len(t) * 3 // 4].encode()) for t in base]
    assert min(ch.likenesses(list(zip(prints, inserted)))) > 0.8
    short = ch.likenesses(list(zip(prints, cut)))  # chunks are of uneven lengths
    assert min(short) > 0.4 and 0.7 < sum(short) / 100 < 0.8
    assert max(ch.likenesses(list(zip(prints, prints[1:])))) < 0.3
    assert ch.likenesses([("0::", "0::"), ("0::", prints[0]), (prints[0], prints[0])]) == [1.0, 0.0, 1.0]
    every = list(zip(prints + inserted, inserted + cut))
    assert ch.likenesses(every) == pytest.approx([slow_likeness(f, g) for f, g in every])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_neighbours_match_brute_force(spark, parts):
    """Nulls, blanks, long texts, copies; ranges of one row and of many."""
    rows = [r for r in awkward() if r[0] not in (40, 41)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = documents(spark, rows).withColumnRenamed("lang", "fingerprint").repartition(3)
        found = {r["doc_id"]: r for r in ch.edited_neighbours(docs).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = sorted((i, t or "") for i, t, _ in rows)
    assert sorted(found) == [i for i, _ in rows]
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 4
        changed = t[: len(t) - n] + after[:n]
        own, other = ch.fingerprint(t.encode()), ch.fingerprint(changed.encode())
        near = slow_likeness(own, other), slow_likeness(own, ch.fingerprint(after.encode()))
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), own, other)
        assert (r["near_edited"], r["near_next"]) == pytest.approx(near)


def test_neighbours_of_repeated_and_missing_ids(spark):
    rows = [(None, "nobody's text, the first in order", "a"), (7, "same words", "a"), (7, "same words", "a"), (7, "other words", "b"), (9, None, "a")]
    for _ in range(2):  # twice: the order of one id's rows is the same
        found = ch.edited_neighbours(documents(spark, rows)).collect()
        assert sorted(str(r["doc_id"]) for r in found) == ["7", "7", "7", "9", "None"]
        assert [r["near_next"] for r in found if r["n_chars"] == 0] == [0.0]
    alone = ch.edited_neighbours(documents(spark, [(1, "one document alone", "a")])).collect()
    assert [(r["near_edited"] > 0, r["near_next"]) for r in alone] == [(True, 1.0)]
    assert ch.edited_neighbours(documents(spark, [])).collect() == []


def test_very_long_texts():
    text = b"the quick brown fox " * 500_000
    assert len(ch.fingerprint(text)) < 140 and ch.fingerprint(text) == ch.fingerprint(bytes(text))

"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

``character_model`` counts runs of four letters over all documents (a table of
28**4 numbers, whatever the input).  A suspicious token - leetspeak, marks
between letters, letters repeated or spaced out - becomes a lattice: each
character may stand for itself, for the letters that it is used for, for the
end of a word, or for nothing.  Viterbi decoding under the character model picks
the likeliest reading.  The classifier sees restored words alone: ``fit`` learns
a logistic regression over words and word beginnings of restored texts from
labelled rows, and ``score`` applies it to every whole text.

Labels are read for training rows alone: those with crc32(doc_id as text) mod 5
other than 0, and of these a sample of ``fit_rows`` (8,000) by hash of the id.

Edge cases: a null or empty text scores what the model's bias says; tokens,
spaced-out runs and texts of any length are worked on whole, in linear time; of
equally likely readings the first in the order of the tables below counts;
labels that are null are not learned from; a document labelled twice counts as
toxic if either row says so; without labels of both kinds, or without a word
that tells them apart, every score is about the share of toxic labels (0 if
there are none); repeated rows score alike; an empty table gives an empty
result; columns named held_out, score or predicted are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialize, ship, trimmed

SYMBOLS, ORDER = 28, 4  # boundary, a-z, other letters; letters to a run

# What leetspeak characters stand for, and marks put between letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e", "£": "l"}
MARKS = ".-_*~'^/\\,:"
_STRIP = ".,;:!?#$%&*|\"'()[]{}<>-_~"
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_ODD = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|\d[^\W\d_]|[^\W\d_]\d|[$@!|+_]|([^\W\d_])\1\1")
_TRAIL = re.compile(r"(?:!+|([$|+])\1\1+)$")  # signs for emphasis, not for letters

#: Log weights of the channel: a letter in disguise, a sign that stands for
#: nothing, a mark between letters, a letter written twice or more often.
DISGUISED, IGNORED, MARKED, TWICE, OFTEN = -1.0, -9.0, -0.5, -4.0, -0.5


def _letter_class(ch: str) -> int:
    base = unicodedata.normalize("NFKD", ch)[0].lower()
    return ord(base) - 96 if "a" <= base <= "z" else 27 if ch.isalpha() else 0


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point of the basic plane; those beyond count as other letters."""
    return np.array([*(_letter_class(chr(c)) for c in range(0x10000)), 27], np.int64)


def run_counts(text: str) -> np.ndarray:
    """How often each run of four classes stands in a text (28**4 numbers)."""
    c = _classes()[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0x10000)]
    n = max(0, len(c) - ORDER + 1)
    code = sum(c[i : i + n] * SYMBOLS ** (ORDER - 1 - i) for i in range(ORDER))
    return np.bincount(code, minlength=SYMBOLS**ORDER) if n else np.zeros(SYMBOLS**ORDER, np.int64)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(fourth | first three), backed by the counts of three and two."""
    n = counts.reshape((SYMBOLS,) * ORDER).astype(float)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        m = n.sum(axis=tuple(range(ORDER - order)))
        p = (m + 3.0 * p) / (m.sum(axis=-1, keepdims=True) + 3.0)
    return np.log(p).astype(np.float32)


def character_model(docs: DataFrame) -> np.ndarray:
    """:func:`log_model` of every text of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for b in batches:
            held, size = [], 0
            for text in b.column(0):
                held.append(text.as_py())
                size += len(held[-1])
                if size > 1_000_000:
                    total += run_counts("  ".join(held))
                    held, size = [], 0
            total += run_counts("  ".join(held))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(trimmed(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most 28**4
    n = np.zeros(SYMBOLS**ORDER, np.int64)
    n[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return log_model(n)


class Channel:
    """Decodes tokens under a character model."""

    def __init__(self, model: np.ndarray):
        self.p = model.ravel().tolist()

    def lattice(self, token: str, spaced: bool = False) -> Iterator[list[tuple[str, float]]]:
        """For each character what it may stand for, with log weights; a space ends a word."""
        before, run = "", 0
        for i, ch in enumerate(token):
            run = run + 1 if ch == before else 1
            if ch.isalpha():
                ways = [(ch, 0.0)]
                if run > 1:
                    ways.append(("", OFTEN if run > 2 or token[i + 1 : i + 2] == ch else TWICE))
            elif ch in MARKS:
                ways = [("", MARKED), (" ", 0.0)]
            elif letters := LEET.get(ch):
                ways = [(x, DISGUISED) for x in letters] + [("", IGNORED)]
            else:
                ways = [(" ", 0.0), ("", IGNORED)]
            before = ch
            yield ways
            if spaced and i < len(token) - 1:
                yield [("", 0.0), (" ", -1.0)]

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest reading (Viterbi over the last three letters), words apart by spaces.

        A spaced-out run comes without its spaces; words may end after any letter.
        """
        p, top = self.p, SYMBOLS ** (ORDER - 1)
        best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # last letters -> score, letters so far (linked)
        for ways in self.lattice(token, spaced):
            read = [(ch, _letter_class(ch) if ch.strip() else 0, weight) for ch, weight in ways]
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, word) in best.items():
                for ch, c, weight in read:
                    if not ch or ch == " " and not state % SYMBOLS:  # a word that ended ends once
                        key, got, so_far = state, score + weight, word
                    else:
                        at = state * SYMBOLS + c
                        key, got, so_far = at % top, score + weight + p[at], (ch, word)
                    if key not in new or got > new[key][0]:
                        new[key] = (got, so_far)
            best = new
        word = max((score + (p[state * SYMBOLS] if state % SYMBOLS else 0.0), -state, word) for state, (score, word) in best.items())[2]
        out = []
        while word is not None:
            out.append(word[0])
            word = word[1]
        return "".join(reversed(out)).strip()

    def restore(self, token: str) -> list[str]:
        """The words that a lower-case token stands for."""
        if token.startswith(" "):  # a run of spaced-out characters
            return self.decode(token.replace(" ", ""), spaced=True).split()
        core = token.strip(_STRIP)
        if core.isalpha() and not _ODD.search(core):
            return [core]
        whole = _TRAIL.sub("", token.strip(".,;:?#%&*\"'"))
        if _ODD.search(whole) and any(ch.isalpha() for ch in whole):
            return self.decode(whole).split()
        return [core] if core else []

    def tokens(self, text: str) -> set[str]:
        """Distinct tokens of a text; runs of spaced-out characters begin with a space."""
        text = text.lower()
        found = set(text.split())
        found.update(f" {m[0]}" for m in _SPACED.finditer(text))
        return found

    def deobfuscate(self, text: str) -> str:
        """The text in lower case with every suspicious token replaced by its reading."""
        text = _SPACED.sub(lambda m: " ".join(self.restore(f" {m[0]}")), text.lower())
        return " ".join(" ".join(self.restore(t)) or t if _ODD.search(t) else t for t in text.split())


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of 3 to 8 letters."""
    return [f"={word}", *(f"^{word[:n]}" for n in range(3, min(8, len(word) - 1) + 1))]


def choose(pos: dict[str, int], neg: dict[str, int], n1: int, n0: int, most: int = 4_000) -> list[str]:
    """The features that speak most for label 1, by log-likelihood ratio.

    pos, neg: rows with the feature, of n1 and n0 rows of either label.
    """

    def gain(f: str) -> float:
        a, b = pos[f], neg.get(f, 0)
        if a / n1 <= b / n0:
            return 0.0
        part = lambda k, n, p: k * math.log(k / (n * p)) if k else 0.0
        p = (a + b) / (n1 + n0)
        return part(a, n1, p) + part(n1 - a, n1, 1 - p) + part(b, n0, p) + part(n0 - b, n0, 1 - p)

    gains = {f: g for f in pos if (g := gain(f)) > 6}
    return sorted(gains, key=lambda f: (-gains[f], f))[:most]


def regress(sets: list[np.ndarray], labels: np.ndarray, n_features: int) -> np.ndarray:
    """Weights of an L2-penalised logistic regression, bias last (Adam, full batches)."""
    n, y = len(sets), labels.astype(float)
    at = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate([np.zeros(0, np.int64), *sets]).astype(np.int64)
    w, bias = np.zeros(n_features), math.log((y.sum() + 1e-9) / (n - y.sum() + 1e-9))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, 1_001):
        z = np.bincount(at, w[flat], n) + bias
        g = 1 / (1 + np.exp(-z)) - y
        grad = np.append(np.bincount(flat, g[at], n_features) / n + 2e-5 * w, g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return np.append(w, bias)


def thinned(sets: list[np.ndarray], copies: int = 2, share: float = 0.5, seed: int = 4) -> list[np.ndarray]:
    """Copies of toxic rows that keep some of their features, so that one word is enough to tell."""
    rng = np.random.default_rng(seed)
    out = [x[rng.random(len(x)) < share] for x in sets for _ in range(copies)]
    return [x for x in out if len(x)]


def _features_of(words: str) -> set[str]:
    return {f for w in words.split("\n") if w for f in word_features(w)}


def _count(able: set[str] | None):
    """Rows with each feature (of ``able`` if given), counted by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for words in b.column(0).to_pylist():
                found = _features_of(words)
                n.update(found if able is None else found & able)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["f", "n"])

    return run


def fit(sample: DataFrame, least: int = 4, most: int = 4_000) -> tuple[dict[str, int], np.ndarray]:
    """Feature numbers, and weights with the bias last, from rows (y, words).

    Features of at least ``least`` toxic rows are ranked; the best ``most``
    enter the regression.  The driver gets counts of the former and, of each
    row of the (bounded) sample, the numbers of the latter.
    """
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}, np.array([math.log((n1 + 1e-9) / (n0 + 1e-9)) if n1 or n0 else -60.0])

    def counts(label: int, able: set[str] | None, floor: int) -> dict[str, int]:
        rows = sample.filter(F.col("y") == label).select("words").mapInArrow(trimmed(_count(able)), "f string, n long")
        got = rows.groupBy("f").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor).toPandas()
        return dict(zip(got["f"], got["n"].tolist()))

    pos = counts(1, None, least)
    chosen = choose(pos, counts(0, set(pos), 1), n1, n0, most)
    if not chosen:  # nothing tells the labels apart: their share, leaning to clean
        return {}, np.array([math.log((n1 + 0.5) / (n0 + 2))])
    number = {f: i for i, f in enumerate(chosen)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sorted(number[f] for f in _features_of(w) if f in number) for w in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["d", "y", "feats"])

    rows = sample.select("d", "y", "words").mapInArrow(trimmed(numbers), "d long, y int, feats array<int>").toPandas().sort_values("d", kind="stable")
    sets, y = [np.asarray(x, np.int64) for x in rows["feats"]], rows["y"].to_numpy()
    more = thinned([x for x, label in zip(sets, y) if label])
    return number, regress(sets + more, np.append(y, np.ones(len(more), y.dtype)), len(chosen))


class _Seen(dict):
    """Model features of a token, worked out once per worker; bounded."""

    def __init__(self, channel: Channel, number: dict[str, int]):
        self.channel, self.number = channel, number

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 250_000:
            self.clear()
        found = {self.number[f] for w in self.channel.restore(token) for f in word_features(w) if f in self.number}
        got = self[token] = tuple(sorted(found))
        return got


class Model:
    """A fitted scorer."""

    def __init__(self, characters: np.ndarray, number: dict[str, int], weights: np.ndarray):
        self.characters, self.number, self.weights = characters, number, weights

    def scorer(self):
        channel = Channel(self.characters)
        seen, w = _Seen(channel, self.number), self.weights

        def score(text: str | None) -> float:
            feats: set[int] = set()
            for found in map(seen.__getitem__, channel.tokens(text or "")):
                if found:
                    feats.update(found)
            z = float(w[-1]) + sum(float(w[i]) for i in sorted(feats))
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def held_out(doc_id) -> bool:
    return crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 8_000) -> Model:
    """Fit the character model on all of ``docs`` and the scorer on a sample of labelled rows."""
    ship(docs.sparkSession)
    characters = character_model(docs)
    usable = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_d")).agg(F.max("toxic").cast("int").alias("_y"))
    usable = usable.filter(F.crc32(F.col("_d").cast("string").cast("binary")) % 5 != 0)
    sample = usable.orderBy(F.xxhash64("_d"), "_d").limit(fit_rows)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(characters)
        for b in batches:
            out = []
            for text in (t.as_py() for t in b.column(1)):
                out.append("\n".join(sorted({w for t in channel.tokens(text or "") for w in channel.restore(t)})))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.string())], ["d", "y", "words"])

    # The sample has at most ``fit_rows`` rows of two numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(F.broadcast(sample), "_d").select("_d", "text", "_y")
    number, weights = fit(materialize(texts.mapInArrow(trimmed(words), "d long, y int, words string"), "labelled-words"))
    return Model(characters, number, weights)


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 8_000, threshold: float = 0.5) -> DataFrame:
    """All of ``docs`` with held_out, score and predicted."""
    model = train(docs, labels, fit_rows)
    docs = docs.drop("held_out", "score", "predicted")
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                s = pa.array([score(t.as_py()) for t in part.column(text)], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, s], [*names, "score"])

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    out = docs.mapInArrow(trimmed(run), schema)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.withColumn("held_out", F.coalesce(held, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Small tables with the awkward cases of every column."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def documents(spark, rows):
    full = [(i, t, None if i is None or i % 5 == 0 else "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def awkward(seed=0):
    """(doc_id, text, source): copies, shared passages, nulls, blanks, a long text, repeated rows."""
    rng = random.Random(seed)
    passage, line = " ".join(words(rng, 60)), " ".join(words(rng, 12))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, " ".join(words(rng, 34)), "b")]
    for i in range(6, 30):
        parts = [" ".join(words(rng, rng.randrange(5, 120)))]
        if i % 3 == 0:
            parts.insert(rng.randrange(2), passage)
        if i % 2 == 0:
            parts.append(line)
        rows.append((i, "\n".join(parts), rng.choice(["a", "b", None, "ünïcode"])))
    copy = rows[10][1]
    rows += [(i, copy, "a") for i in range(30, 36)]
    rows += [(36, copy + " extra", "a"), (37, " ".join(words(rng, 6000)), "hot"), (38, "x " * 200, "b"), (39, "é" * 3000 + " ß", "b")]
    rows += [(40, rows[8][1], "b"), (40, rows[8][1], "b"), (41, "the same id", "a"), (41, "another text", "b")]
    return rows

"""Many phrases at once against one ``contains`` each."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import lexicons as lex
from folioscope.functions import routing
from folioscope.operators import phrases

LISTS = {"objective": lex.OBJECTIVE_QUERY, "tabular": lex.TABLE_WORDS, "visual": lex.VISUAL_WORDS, "fusion": lex.FUSION_WORDS, "comparison": lex.COMPARISON_PHRASES}


def test_flags_of_questions(spark):
    texts = ["Say what the picture of page 1 shows", "Compare the documents", "columns of data", "", None, "WHY is the growth so", "hello"]
    asked = spark.createDataFrame(list(enumerate(texts)), "q_id long, question string").withColumn("tags", F.lit("old"))
    lexicon = spark.createDataFrame([(p.upper(), t) for t, ps in LISTS.items() for p in ps] + [("", "empty"), (None, "null"), ("hello", None)], "phrase string, tag string")
    rows = phrases.with_tags(asked, F.col("question"), lexicon)
    q = F.col("question")
    rules = dict(objective=routing.is_objective(q), tabular=routing.is_table(q), visual=routing.is_visual(q), fusion=routing.is_fusion(q), comparison=routing.is_comparison(q))
    for r in rows.select("q_id", "tags", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()]).collect():
        assert set(r["tags"]) == {n for n in rules if r[n]} and r["tags"] == sorted(r["tags"])


def test_a_pack_of_a_hundred_thousand_phrases(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(100_000)]
    lexicon = spark.createDataFrame([(w, f"t{len(w)}{w[0]}") for w in words], "phrase string, tag string")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    got = {r["i"]: r["tags"] for r in phrases.with_tags(spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3), F.col("text"), lexicon).collect()}
    held = set(words)
    for i, t in enumerate(texts):
        met = {t[a:b] for a in range(len(t)) for b in range(a + 3, min(a + 9, len(t)) + 1)} & held
        assert got[i] == sorted({f"t{len(w)}{w[0]}" for w in met})


def test_empty_and_too_large_lexicons(spark, monkeypatch):
    rows, none = spark.createDataFrame([(1, "text")], "i long, text string"), spark.createDataFrame([], "phrase string, tag string")
    assert [r["tags"] for r in phrases.with_tags(rows, F.col("text"), none).collect()] == [[]]
    monkeypatch.setattr(phrases, "MOST_PHRASES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        phrases.with_tags(rows, F.col("text"), spark.createDataFrame([("a", "x"), ("b", "x")], "phrase string, tag string"))

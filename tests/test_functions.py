"""Golden values of the text, quality and routing expressions."""

import pytest
from pyspark.sql import functions as F

from folioscope import fixtures as fx
from folioscope.functions import lexicons, quality, routing, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (text.clean_ingest, "ab-\ncd-\nef", "abcdef"),
        (text.clean_chunk, "ab-\ncd-\nef", "abcd-\nef"),
        (text.clean_ingest, "a-\nb-\nc", "ab-\nc"),
        (text.clean_ingest, " x \t  y\r\n\r\n\r\nz ", "x y\n\nz"),
        (text.clean_ingest, None, ""),
        (text.clean_chunk, "naïve-\nté über", "naïveté über"),
        (text.normalize_ws, " a   b\n", "a b"),
        (text.normalize_eval, "The Main_Objective\\X", "the main objective x"),
        (text.word_count, " a  b c ", 3),
        (text.word_count, None, 0),
        (text.tokens, "Été 0.9593, 1,000 a.b.c café!", ["t", "0.9593", "1,000", "a.b.c", "caf"]),
        (text.sentences, "A b. C d!  E? F 0.5 x", ["A b.", "C d!", "E?", "F 0.5 x"]),
        (text.sentences, "See Fig. 3 vs. it. End.", ["See Fig. 3 vs. it.", "End."]),
        (text.sentences, "e.g. one i.e. two. Three", ["e.g. one i.e. two.", "Three"]),
        (text.sentences, "Use <DOT> here. Ok", ["Use . here.", "Ok"]),
        (text.sentences, "", []),
        (text.dominant_script, "42", "latin"),
        (text.dominant_script, "!!", "unknown"),
        (text.dominant_script, "ಕನ್ನಡ", "kannada"),
        (text.dominant_script, "ab कख", "latin"),
        (text.file_stem, "My file (1).v2.pdf", "My_file__1_.v2"),
        (routing.requested_page, "See page 3 and p. 4", 3),
        (routing.requested_page, "p.7", 7),
        (routing.requested_page, "pg 9", 9),
        (routing.requested_page, "Page12", 12),
        (routing.requested_page, "none", None),
        (routing.table_number, "table did show", "DID"),
        (routing.table_number, "Table iv", "IV"),
        (routing.table_number, "table 7", "7"),
        (routing.route, "Say what the picture of page 1 shows", "fusion"),
        (routing.route, "Compare the documents", "comparison"),
        (routing.route, "columns of data", "table"),
        (routing.route, "picture of a cat", "visual"),
        (routing.route, "hello", "text"),
        (routing.intent, "Who wrote the model paper?", "header"),
        (routing.intent, "What is the aim?", "abstract"),
        (routing.intent, "hello", "general"),
    ],
)
def test_golden(spark, f, given, expected):
    assert one(spark, f(F.col("t").cast("string")), t=given) == expected


@pytest.mark.parametrize(
    ("given", "counts"),
    [("été 1!", (1, 0, 0, 1, 3)), ("कखग ab", (2, 3, 0, 0, 0)), ("ಕನ್ನಡ", (0, 0, 5, 0, 0)), (None, (0, 0, 0, 0, 0))],
)
def test_script_counts(spark, given, counts):
    n = text.script_counts(F.col("t").cast("string"))
    assert tuple(one(spark, F.array(*n.values()), t=given)) == counts


@pytest.mark.parametrize(("given", "confidence", "expected"), [("hello world", 90.0, 0.0569), ("ab " * 40, 50.0, 0.2405), (" ".join("abcdefghijklmnopqrstuvwxyz"), 80.0, 0.4457), ("", 90.0, 0.0)])
def test_text_quality(spark, given, confidence, expected):
    assert one(spark, quality.text_quality(F.col("t"), F.col("c")), t=given, c=confidence) == pytest.approx(expected, abs=1e-4)


@pytest.mark.parametrize(("given", "confidence", "lang", "valid"), [("क", 0.9, "hindi", False), ("कखग", 0.9, "hindi", True), ("ab", 0.19, "other", False), ("ab", 0.2, "other", True), ("!!!a", 0.9, "latin", True), ("", 0.9, "other", False)])
def test_valid_candidate(spark, given, confidence, lang, valid):
    assert one(spark, quality.valid_candidate(F.col("t"), F.col("c"), F.col("lang")), t=given, c=confidence, lang=lang) is valid


def test_expansion_follows_the_pack(spark):
    q = "What is the purpose of HAISAS xgboost?"
    full = one(spark, routing.expand(F.col("t"), fx.DOMAIN_PACK), t=q)
    assert full.startswith(q + " Hybrid AI IoT") and full.endswith("98% 0.94") and " objective purpose aim goal " in full
    assert one(spark, routing.expand(F.col("t")), t=q) == q == one(spark, routing.expand(F.col("t"), lexicons.DomainPack()), t=q)


def test_objective_score_reaches_one(spark):
    said = "this paper proposes an integrated framework for monitoring and prediction; purpose, aim, goal, objective, automated control, fish health, aquaponics"
    assert one(spark, routing.objective_score(F.col("c"), F.col("t"), fx.DOMAIN_PACK), t=said, c="what is the aim") == pytest.approx(1.0)
    assert one(spark, routing.objective_score(F.col("c"), F.col("t"), fx.DOMAIN_PACK), t=said, c="hello") == 0.0


def test_vertical_overlap(spark):
    assert one(spark, quality.vertical_overlap(F.lit(0), F.lit(10), F.lit(5), F.lit(25)), t="") == pytest.approx(0.5)

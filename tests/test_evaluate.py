"""Conversations evaluated in rounds, by an engine and by a plain function."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import evaluation, memory
from folioscope.plans import evaluate
from folioscope.plans.engine import Engine, ingest
from folioscope.sources import pages as src

CASE = "conv_id long, turn long, question string"


def echo(asked, turns):
    """Says the question and how many characters of memory it saw."""
    seen = memory.memory_context(turns)
    df = asked.join(seen, "conv_id", "left")
    answer = F.concat(F.lit("re "), "question", F.lit(" "), F.coalesce(F.length("memory"), F.lit(0)).cast("string"))
    return df.select("conv_id", answer.alias("answer"), F.when(F.col("question") != "quiet", answer).alias("spoken"))


def slow(cases):
    out, past = {}, {}
    for conv, turn, question in sorted(c for c in cases if None not in c and c[2].strip()):
        last = past.setdefault(conv, [])[-4:]
        seen = "\n\n".join(f"User: {q}\nAssistant: {a[:1000]}" for q, a in last)[:3500]
        answer = f"re {question} {len(seen)}"
        out[conv, turn] = answer
        if question != "quiet":
            past[conv].append((question, answer))
    return out


def test_rounds_equal_one_conversation_after_the_other(spark):
    cases = [(c, t * 2, f"question {t} of {c}" + " long" * 300 * (c == 3)) for c in range(4) for t in range(c * 2 + 1)]
    cases += [(9, 1, "first"), (9, 2, "quiet"), (9, 5, "third"), (9, 7, "  "), (None, 1, "x"), (9, None, "y")]
    said = evaluate.converse(spark.createDataFrame(cases, CASE).repartition(3), echo)
    assert {(r["conv_id"], r["turn"]): r["answer"] for r in said.collect()} == slow(cases)
    assert evaluate.converse(spark.createDataFrame([], CASE), echo).collect() == []


@pytest.fixture
def engine(spark, tmp_path):
    rows = [("a.pdf", 1, "Fish tanks need clean water and a pump."), ("b.pdf", 1, "Trains run on steel rails between stations.")]
    df = spark.createDataFrame(rows, "source string, page int, text string").selectExpr("*", "false AS ocr_used", "CAST(NULL AS struct<path:string,width:int,height:int,dpi:int>) AS page_image", f"CAST(NULL AS array<{src.IMAGE}>) AS images", f"CAST(NULL AS array<{src.TABLE}>) AS tables")
    src.write_table(src.page_elements(df), f"{tmp_path}/elements")
    ingest(spark, f"{tmp_path}/elements", f"{tmp_path}/index")
    return Engine(spark, f"{tmp_path}/index")


def test_an_engine_remembers_in_the_second_round(spark, engine):
    cases = spark.createDataFrame([(1, 0, "fish tanks and the pump"), (1, 1, "clean water of it"), (2, 0, "steel rails")], CASE)
    said = evaluate.converse(cases, evaluate.by_engine(engine))
    expected = spark.createDataFrame(
        [(1, 1, "follow-up", "memory", ["clean water", "pump"]), (2, 0, "rails", "text", ["steel", "stations", "wheels"]), (7, 0, "never asked", "text", ["x"])],
        "conv_id long, turn long, name string, category string, expected_terms array<string>",
    )
    rows = evaluate.scored(said, expected)
    got = {r["name"]: (round(r["score"], 3), r["passed"], r["missing"]) for r in rows.collect()}
    assert got == {"follow-up": (1.0, True, []), "rails": (0.667, False, ["wheels"]), "never asked": (0.0, False, ["x"])}
    whole = evaluation.eval_summary(rows).first()
    assert (whole["total"], whole["n_passed"]) == (3, 1)

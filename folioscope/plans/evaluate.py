"""Evaluation of whole conversations: every round answers one turn of all cases at once.

A case is a conversation of questions in the order of their turns, some with terms that
the answer must name.  Round r asks what is each case's r-th question, in the light of
what was said before; answers and the memory they leave are written tables, so a round
never works out an earlier one again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluation, memory
from ..sources.store import written
from .engine import Engine

TURN = "conv_id long, turn long, question string, answer string"
#: (conv_id, question) of a round and the turns before -> (conv_id, answer, spoken).
Answer = Callable[[DataFrame, DataFrame], DataFrame]


def by_engine(engine: Engine, **how) -> Answer:
    """Answers of an engine, with memory; ``how`` goes to :meth:`Engine.answer`."""

    def answer(asked: DataFrame, turns: DataFrame) -> DataFrame:
        questions = asked.select(F.col("conv_id").alias("q_id"), "conv_id", "question")
        return engine.answer(questions, turns, **how).select(F.col("q_id").alias("conv_id"), "answer", "spoken")

    return answer


def converse(cases: DataFrame, answer: Answer) -> DataFrame:
    """(conv_id, turn, question, answer) of all turns of ``cases`` (conv_id, turn, question).

    There are as many rounds as the longest case has turns; blank questions and rows
    without a conversation or turn are left out.  Memory keeps each conversation's last
    turns with answers, as they were spoken.
    """
    asked = cases.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND trim(question) <> ''").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "question")
    asked = written(asked.withColumn("_round", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "question"))), "cases")
    spark, said = cases.sparkSession, []
    kept = spark.createDataFrame([], TURN)
    for r in range(1, (asked.agg(F.max("_round")).first()[0] or 0) + 1):
        now = asked.filter(F.col("_round") == r).drop("_round")
        met = now.join(answer(now.select("conv_id", "question"), kept), "conv_id", "left").withColumn("spoken", F.coalesce("spoken", F.lit("")))
        said.append(written(met.select("conv_id", "turn", "question", "answer", "spoken"), "round"))
        new = said[-1].filter("spoken <> ''").select("conv_id", "turn", "question", F.col("spoken").alias("answer"))
        kept = written(memory.memory_window(kept.unionByName(new)).drop("age"), "memory")
    out = spark.createDataFrame([], TURN)
    for df in said:
        out = out.unionByName(df.drop("spoken"))
    return out


def scored(said: DataFrame, expected: DataFrame) -> DataFrame:
    """Answers to the turns of ``expected`` (conv_id, turn, name, category, expected_terms) with their scores.

    A turn that was never answered scores as an empty answer.
    """
    answers = said.select("conv_id", "turn", "answer")
    return evaluation.eval_terms(expected.join(answers, ["conv_id", "turn"], "left").withColumn("answer", F.coalesce("answer", F.lit(""))))

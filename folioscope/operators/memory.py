"""Conversation memory, per conversation: the last turns and the question in their light."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURNS, ANSWER_CHARS, MEMORY_CHARS = 4, 1000, 3500


def answered_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): user messages with the reply right after; others are skipped."""
    said = messages.filter(F.col("role") != "system")
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = said.withColumn("_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return df.filter("role = 'user' AND _role = 'assistant' AND answer <> ''").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def memory_window(turns: DataFrame, keep: int = TURNS) -> DataFrame:
    """The last turns of each conversation, the latest with age 1."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= keep)


def memory_text(turns: Column) -> Column:
    """What an array of turns (turn, question, answer) said, in their order, cut to length."""
    part = lambda t: F.concat(F.lit("User: "), t["question"], F.lit("\nAssistant: "), F.left(t["answer"], F.lit(ANSWER_CHARS)))
    return F.left(F.array_join(F.transform(F.sort_array(turns), part), "\n\n"), F.lit(MEMORY_CHARS))


def memory_context(turns: DataFrame) -> DataFrame:
    """(conv_id, memory): what the last turns said, cut to length."""
    return memory_window(turns).groupBy("conv_id").agg(memory_text(F.collect_list(F.struct("turn", "question", "answer"))).alias("memory"))


def contextual_query(questions: DataFrame, memory: DataFrame) -> DataFrame:
    """(conv_id, question, query): the question alone, or with memory for what words refer to."""
    df = questions.join(memory, "conv_id", "left")
    wrapped = F.concat(F.lit("Earlier in this conversation:\n"), F.col("memory"), F.lit("\n\nQuestion now:\n"), F.col("question"), F.lit("\n\nEarlier turns only say what it, this, that, the model or the result stands for."))
    return df.select("conv_id", "question", F.when(F.coalesce("memory", F.lit("")) == "", F.col("question")).otherwise(wrapped).alias("query"))

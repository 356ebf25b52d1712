"""Memory kept by a stream against memory worked out from all messages."""

import os
import random
from pathlib import Path

import pytest

from folioscope.operators import memory
from folioscope.streaming import memory as stream

MESSAGES = "conv_id long, turn long, role string, text string"


def conversations(seed=2, n=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 30)):
            text = rng.choice([f"words {conv} {turn}", "", None, "long " * 900]) if rng.random() < 0.4 else f"said {turn} in {conv}"
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system"]), text))
    return rows + [(99, t, ("user", "assistant")[t % 2], f"hot {t}") for t in range(400)]  # a third of all rows


def put(spark, folder, rows):
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **more):
    stream.start_memory(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", **more).awaitTermination()
    return {r["conv_id"]: r["memory"] for r in stream.current_memory(spark, f"{tmp_path}/out").collect()}


def whole(spark, rows):
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    return {r["conv_id"]: r["memory"] for r in memory.memory_context(memory.answered_turns(spark.createDataFrame(known, MESSAGES))).collect()}


def test_stream_equals_batch_as_input_grows(spark, tmp_path):
    rows, rng, seen = conversations(), random.Random(1), []
    before = spark.conf.get(stream.PROVIDER, None)
    for first, last in ((0, 7), (7, 8), (8, 500)):  # turns of each step, in any order within it
        step = [r for r in rows if first <= r[1] < last]
        rng.shuffle(step)
        seen += step
        put(spark, f"{tmp_path}/in", step)
        assert run(spark, tmp_path) == whole(spark, seen)
    files = sorted(p.name for p in Path(tmp_path, "out").glob("batch=*"))
    assert len(files) == 3 and run(spark, tmp_path) == whole(spark, rows)  # nothing new: no further batch
    assert sorted(p.name for p in Path(tmp_path, "out").glob("batch=*")) == files
    assert spark.conf.get(stream.PROVIDER, None) == before


def test_stream_starts_again_from_its_checkpoint(spark, tmp_path):
    rows = conversations(5)
    put(spark, f"{tmp_path}/in", [r for r in rows if r[1] < 9])
    run(spark, tmp_path)
    put(spark, f"{tmp_path}/in", [r for r in rows if r[1] >= 9])
    after = run(spark, tmp_path)
    for f in Path(tmp_path, "checkpoint", "commits").glob("*1*"):  # the second trigger did not finish
        f.unlink()
    assert run(spark, tmp_path) == after == whole(spark, rows)


def test_late_repeated_and_odd_messages(spark, tmp_path):
    rows = [(1, 0, "user", "q0"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2")]
    put(spark, f"{tmp_path}/in", [*rows, (None, 0, "user", "x"), (1, None, "user", "x"), (1, 3, None, "x"), (2, 0, "user", "alone")])
    first = run(spark, tmp_path)
    assert first == {1: "User: q0\nAssistant: a1"}
    put(spark, f"{tmp_path}/in", [*rows, (1, 3, "assistant", "a3")])  # told again, with one more
    assert run(spark, tmp_path) == {1: "User: q0\nAssistant: a1\n\nUser: q2\nAssistant: a3"}


def test_silent_conversations_are_forgotten(spark, tmp_path):
    """By the times of the files: a pause within ``silence_ms`` keeps a conversation, a longer one ends it."""

    def told(second, rows):
        known = set(Path(tmp_path, "in").glob("*.parquet"))
        put(spark, f"{tmp_path}/in", rows)
        for p in set(Path(tmp_path, "in").glob("*.parquet")) - known:
            os.utime(p, (1_700_000_000 + second, 1_700_000_000 + second))
        return run(spark, tmp_path, silence_ms=10_000)

    one = "User: q0\nAssistant: a1"
    assert told(0, [(1, 0, "user", "q0"), (1, 1, "assistant", "a1"), (2, 0, "user", "q0"), (2, 1, "assistant", "a1")]) == {1: one, 2: one}
    two = told(5, [(1, 2, "user", "q2"), (1, 3, "assistant", "a3")])
    assert two[1] == f"{one}\n\nUser: q2\nAssistant: a3"
    after = told(30, [(1, 4, "user", "q4"), (1, 5, "assistant", "a5"), (3, 0, "user", "q0"), (3, 1, "assistant", "a1")])
    assert after[1] == "User: q4\nAssistant: a5" and after[3] == one
    last = told(31, [(3, 2, "user", "q2")])
    assert set(last) == {1, 3}  # the second conversation's state is gone
    assert told(3, [(3, 3, "assistant", "a3")])[3] == f"{one}\n\nUser: q2\nAssistant: a3"  # an old file is not too late


@pytest.mark.parametrize("rows", [[]])
def test_stream_of_nothing(spark, tmp_path, rows):
    spark.createDataFrame(rows, MESSAGES).write.parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path) == {}

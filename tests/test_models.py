"""Model calls: once a prompt, spread, with errors beside answers."""

import os
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from folioscope.operators import evidence, models, visual


class Counting:
    """Answers, and leaves a file for each call."""

    def __init__(self, folder, fails=(), once=()):
        self.folder, self.fails, self.once = str(folder), fails, once

    def __call__(self, *prompt):
        name = "|".join("" if p is None else p for p in prompt)
        first = not any(n.startswith(f"{name}.") for n in os.listdir(self.folder))
        Path(self.folder, f"{name}.{uuid.uuid4().hex}").touch()
        if name in self.fails or first and name in self.once:
            raise ValueError(f"no {name}")
        return f"said {name}"


def calls(folder):
    return sorted(n.split(".")[0] for n in os.listdir(folder))


def test_equal_prompts_are_asked_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, "abc"[i % 3], "x" if i % 2 else None) for i in range(60)] + [(99, "skip", "x")], "id long, q string, c string").repartition(5)
    got = {r["id"]: (r["answer"], r["error"]) for r in models.ask(rows, ["q", "c"], Counting(tmp_path), F.col("q") != "skip").collect()}
    assert calls(tmp_path) == ["a|", "a|x", "b|", "b|x", "c|", "c|x"]
    assert got[99] == (None, None) and len(got) == 61
    assert all(got[i] == (f"said {'abc'[i % 3]}|{'x' if i % 2 else ''}", None) for i in range(60))


def test_failures_are_tried_again_then_shown(spark, tmp_path):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "flaky"), (4, "bad")], "id long, q string")
    got = {r["id"]: (r["answer"], r["error"]) for r in models.ask(rows, ["q"], Counting(tmp_path, ["bad"], ["flaky"]), attempts=2).collect()}
    assert got == {1: ("said good", None), 2: (None, "ValueError: no bad"), 3: ("said flaky", None), 4: (None, "ValueError: no bad")}
    assert calls(tmp_path) == ["bad", "bad", "flaky", "flaky", "good"]


def test_a_worker_loads_a_model_once(spark, tmp_path):
    def load():
        Path(str(tmp_path), f"load-{os.getpid()}.{uuid.uuid4().hex}").touch()
        return lambda q: f"said {q}"

    rows = spark.createDataFrame([(i, f"q{i}") for i in range(40)], "id long, q string")
    model = models.Loaded(load)
    assert {r["answer"] for r in models.ask(rows, ["q"], model, parallel=1).collect()} == {f"said q{i}" for i in range(40)}
    assert {r["answer"] for r in models.ask(rows, ["q"], model, parallel=1).collect()} == {f"said q{i}" for i in range(40)}
    loads = calls(tmp_path)
    assert len(loads) == len(set(loads)) <= 4  # tasks run in four workers at most


def test_answers_of_a_model_that_fails(spark, tmp_path):
    found = spark.createDataFrame([(q, 1, "s", 1, q, "body", "text", t) for q, t in ((1, "one"), (2, "two"))], "q_id long, rank int, source string, page int, chunk_id long, region string, content_type string, text string")
    asked = spark.createDataFrame([(1, "good?"), (2, "bad?"), (3, "nothing found?")], "q_id long, question string")

    def answerer(question, context):
        if question == "bad?":
            raise TimeoutError("too slow")
        return f"about {context.split('Evidence:')[1].split()[0]}"

    got = {r["q_id"]: r for r in evidence.answer_questions(asked, found, answerer).collect()}
    assert got[1]["answer"] == "about one\n\n[Source 1]" and got[1]["spoken"] == "about one" and got[1]["error"] is None
    assert (got[2]["answer"], got[2]["cited"], got[2]["spoken"], got[2]["error"]) == (evidence.FAILED, [], "", "TimeoutError: too slow")
    assert got[3]["answer"] == evidence.NO_ANSWER
    pages = spark.createDataFrame([(1, 1, "s", 1, "a.png"), (1, 2, "s", 2, "b.png"), (2, 1, "s", 1, "a.png")], "q_id long, place int, source string, page int, path string")
    same = spark.createDataFrame([(1, "what is it"), (2, "what is it")], "q_id long, question string")
    look = Counting(tmp_path)
    seen = visual.analyze_pages(pages, same, lambda prompt, path: look(path) if path != "a.png" else look.__class__(look.folder, ["a.png"])(path)).collect()
    assert [(r["q_id"], r["number"]) for r in seen] == [(1, 2)]  # numbers keep their gaps
    assert calls(tmp_path) == ["a", "a", "b"]  # asked once for both questions, tried twice

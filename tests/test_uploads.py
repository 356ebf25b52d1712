"""Uploads in the background: steps, refusal, failure and stopping."""

import threading
import time

import numpy as np
import pytest

from folioscope.operators import embedding
from folioscope.plans import uploads
from folioscope.plans.engine import Engine, ingest
from folioscope.plans.versions import STEPS
from folioscope.sources import pages as src


@pytest.fixture
def index(spark, tmp_path):
    def write(name, rows):
        df = spark.createDataFrame(rows, "source string, page int, text string").selectExpr("*", "false AS ocr_used", "CAST(NULL AS struct<path:string,width:int,height:int,dpi:int>) AS page_image", f"CAST(NULL AS array<{src.IMAGE}>) AS images", f"CAST(NULL AS array<{src.TABLE}>) AS tables")
        src.write_table(src.page_elements(df), f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    ingest(spark, write("one", [("a.pdf", 1, "Fish tanks need clean water.")]), f"{tmp_path}/index")
    return f"{tmp_path}/index", write("two", [("b.pdf", 1, "Trains run on rails.")])


def test_steps_come_in_order_and_a_second_upload_is_refused(spark, index):
    at, more = index
    engine = Engine(spark, at)
    queue = uploads.Uploads(engine)
    assert queue.status.state == "idle"
    go, upload = threading.Event(), engine.upload
    engine.upload = lambda path, begin: (go.wait(60), upload(path, begin))
    queue.start(more)
    with pytest.raises(uploads.Busy, match="taken in"):
        queue.start(more)
    asked = spark.createDataFrame([(1, "clean water")], "q_id long, question string")
    assert engine.search(asked, 1).first()["source"] == "a.pdf"  # answered meanwhile
    go.set()
    done = queue.wait(300)
    assert (done.state, done.steps, done.step, done.processing) == ("done", list(STEPS), len(STEPS), False)
    assert {r["source"] for r in engine.sources().collect()} == {"a.pdf", "b.pdf"}
    engine.upload = upload
    queue.start(more)  # free again
    assert queue.wait(300).state == "done"


def test_a_failed_upload_says_why_and_changes_nothing(spark, index, tmp_path):
    at, _ = index
    engine = Engine(spark, at)
    queue = uploads.Uploads(engine)
    queue.start(f"{tmp_path}/nowhere")
    failed = queue.wait(300)
    assert failed.state == "failed" and "nowhere" in failed.message and len(failed.message) <= 200 and failed.steps == []
    assert {r["source"] for r in Engine(spark, at).sources().collect()} == {"a.pdf"}


def test_an_upload_can_be_stopped(spark, index):
    at, more = index

    def slow(texts):
        time.sleep(120)
        return np.ones((len(texts), 4))

    engine = Engine(spark, at, encoder=slow)
    queue = uploads.Uploads(engine)
    queue.stop()  # nothing runs
    queue.start(more)
    began = time.time()
    while queue.status.state != "vectors" and time.time() - began < 100:
        time.sleep(0.2)
    time.sleep(2)
    queue.stop()
    stopped = queue.wait(60)
    assert (stopped.state, stopped.processing) == ("stopped", False) and time.time() - began < 110
    assert {r["source"] for r in Engine(spark, at).sources().collect()} == {"a.pdf"}
    engine.encoder = embedding.hashing_encoder
    queue.start(more)
    assert queue.wait(300).state == "done" and engine.version.number == 2

"""Versions of an index: replaced sources, readers that keep theirs, runs that die half-way."""

import pytest

from folioscope.operators.inverted import InvertedIndex
from folioscope.plans import versions
from folioscope.plans.engine import Engine, ingest
from folioscope.sources import pages as src


@pytest.fixture
def elements(spark, tmp_path):
    def write(name, rows):
        df = spark.createDataFrame(rows, "source string, page int, text string").selectExpr("*", "false AS ocr_used", "CAST(NULL AS struct<path:string,width:int,height:int,dpi:int>) AS page_image", f"CAST(NULL AS array<{src.IMAGE}>) AS images", f"CAST(NULL AS array<{src.TABLE}>) AS tables")
        src.write_table(src.page_elements(df), f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    return write


def held(engine):
    return sorted((r["source"], r["text"]) for r in engine.chunks.collect())


FISH, RAIL, SHIP = "Fish tanks need clean water.", "Trains run on rails.", "Ships sail the sea."


def test_upload_replaces_and_readers_keep_their_version(spark, tmp_path, elements):
    at = f"{tmp_path}/index"
    assert ingest(spark, elements("one", [("a.pdf", 1, FISH), ("b.pdf", 1, RAIL)]), at) == 1
    reader, writer = Engine(spark, at), Engine(spark, at)
    writer.upload(elements("two", [("a.pdf", 1, "Tanks now hold shrimps."), ("c.pdf", 1, SHIP)]))
    assert held(writer) == [("a.pdf", "Tanks now hold shrimps."), ("b.pdf", RAIL), ("c.pdf", SHIP)]
    assert held(reader) == [("a.pdf", FISH), ("b.pdf", RAIL)]
    asked = spark.createDataFrame([(1, "clean water of tanks")], "q_id long, question string")
    assert reader.search(asked, 1).first()["text"] == FISH and writer.search(asked, 1).first()["text"] == "Tanks now hold shrimps."
    ids = [r["chunk_id"] for r in writer.chunks.collect()]
    assert len(ids) == len(set(ids)) and sorted(ids) == sorted(r["chunk_id"] for r in writer.vectors.collect())
    writer.upload(f"{tmp_path}/two")  # the same again
    assert held(writer) == [("a.pdf", "Tanks now hold shrimps."), ("b.pdf", RAIL), ("c.pdf", SHIP)]
    reader.reload()
    assert reader.version.number == 3 and held(reader) == held(writer)
    assert reader.dense(asked, 1).count() <= 1
    writer.delete("b.pdf")
    assert [s for s, _ in held(writer)] == ["a.pdf", "c.pdf"] and len(versions.manifest(spark, at)) == 4
    assert len(versions.drop_old_versions(spark, at, keep=1)) == 3
    assert held(Engine(spark, at)) == held(writer)


@pytest.mark.parametrize("where", ["postings", "facts"])
def test_a_run_that_dies_leaves_the_version_before(spark, tmp_path, elements, monkeypatch, where):
    at = f"{tmp_path}/index"
    ingest(spark, elements("one", [("a.pdf", 1, FISH)]), at)
    engine = Engine(spark, at)

    def dies(*a, **b):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(InvertedIndex, "build" if where == "postings" else "_write", dies)
        with pytest.raises(RuntimeError):
            engine.upload(elements("two", [("a.pdf", 1, RAIL), ("b.pdf", 1, SHIP)]))
    assert held(engine) == held(Engine(spark, at)) == [("a.pdf", FISH)]
    asked = spark.createDataFrame([(1, "clean water")], "q_id long, question string")
    assert Engine(spark, at).search(asked, 1).first()["text"] == FISH
    engine.upload(f"{tmp_path}/two")  # and the run is simply made again
    assert held(Engine(spark, at)) == [("a.pdf", RAIL), ("b.pdf", SHIP)]


def test_no_index_and_unsound_indexes(spark, tmp_path, elements):
    with pytest.raises(ValueError, match="no index"):
        Engine(spark, f"{tmp_path}/nothing")
    with pytest.raises(ValueError, match="embedded"):
        ingest(spark, elements("blank", [("a.pdf", 1, " ")]), f"{tmp_path}/index")
    assert versions.manifest(spark, f"{tmp_path}/index") == []

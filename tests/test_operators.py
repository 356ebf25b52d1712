"""Chunking, ranking, OCR, memory, evidence and evaluation on small tables."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope import fixtures as fx
from folioscope.operators import chunking, embedding, evaluation, evidence, memory, ocr, retrieval, visual
from folioscope.plans.engine import Engine, ingest
from folioscope.sources import pages as src
from folioscope.streaming.ingest import start_ingest


def packs(spark, sizes, merge=True):
    sentences = [" ".join(["w"] * n) + "." for n in sizes]
    col = chunking.pack_sentences(F.array(*map(F.lit, sentences)), most=140 if merge else 0)
    got = spark.range(1).select(col.alias("x")).first()["x"]
    return [p["n"] for p in got]


@pytest.mark.parametrize(
    ("sizes", "packed", "merged"),
    [([40, 50, 1], [90, 1], [91]), ([40, 51], [40, 51], [40, 51]), ([150, 10, 85], [150, 10, 85], [150, 10, 85]), ([30, 70, 30], [30, 70, 30], [30, 100]), ([91, 1], [91, 1], [92]), ([10], [10], [10])],
)
def test_packing_and_merging(spark, sizes, packed, merged):
    assert packs(spark, sizes, merge=False) == packed
    assert packs(spark, sizes) == merged


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 160), min_size=1, max_size=25))
def test_packs_keep_all_words_in_bounds(spark, sizes):
    got = packs(spark, sizes)
    assert sum(got) == sum(sizes)
    assert all(n <= 140 or n in sizes for n in got)


def test_page_chunks_ids_are_dense_and_ordered(spark):
    got = chunking.page_chunks(fx.ELEMENTS.spark(spark)).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == list(range(len(got)))
    assert [(r["source"], r["page"], r["content_type"]) for r in got][:4] == [("a.pdf", 1, "text"), ("a.pdf", 1, "table"), ("a.pdf", 1, "image"), ("a.pdf", 2, "visual_page")]
    texts = {(r["page"], r["content_type"]): r["text"] for r in got if r["source"] == "a.pdf"}
    assert texts[3, "table"] == "TABLE 1\nRow 1:  | \nRow 3: a | \n\nTABLE 3\nRow 1: x" or texts[3, "table"].startswith("TABLE 1\nRow 1:  | ")


def test_blank_table_rows(spark):
    df = spark.createDataFrame([([[None, None], [""], ["a", None]],)], "rows array<array<string>>")
    assert df.select(chunking.table_text(F.col("rows")).alias("t")).first()["t"] == "Row 1:  | \nRow 3: a | "


def test_minmax(spark):
    rows = [(1, v) for v in (0.8, 0.0, -0.2, 0.3)] + [(2, 3.0), (2, 3.0)]
    got = retrieval.minmax(spark.createDataFrame(rows, "q_id long, x double"), "x").collect()
    assert sorted(round(r["x"], 9) for r in got if r["q_id"] == 1) == [0.0, 0.2, 0.5, 1.0]
    assert [r["x"] for r in got if r["q_id"] == 2] == [0.0, 0.0]


def chunk_rows(spark):
    rows = [
        (0, "p", 1, "header", "deep sea fish title"),
        (1, "p", 1, "abstract", "the aim of fish tanks and the goal"),
        (2, "p", 2, "body", "sensor data of the tank, sensor again"),
        (3, "q", 1, "table", "unrelated words only"),
        (4, "q", 2, "body", ""),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, page int, region string, text string").withColumn("content_type", F.lit("text"))
    v = np.eye(5)[:4].tolist()
    vectors = spark.createDataFrame(list(enumerate(v)), "chunk_id long, vector array<double>")
    q = [(1, "what is the aim of the sensor", [0.9, 0.1, 0.4, 0.0, 0.0]), (2, "zzz", [0.0, -1.0, 0.0, 0.0, 0.0]), (3, " ", [1.0, 0.0, 0.0, 0.0, 0.0])]
    return chunks, vectors, spark.createDataFrame(q, "q_id long, question string, vector array<double>")


def test_hybrid_search_equals_all_scores(spark):
    chunks, vectors, questions = chunk_rows(spark)
    every = {(r["q_id"], r["chunk_id"]): r for r in retrieval.hybrid_scores(chunks, vectors, questions).collect()}
    got = retrieval.hybrid_search(chunks, vectors, questions, k=5).collect()
    assert {r["q_id"] for r in got} == {1, 2} and len(got) == 10
    for r in got:
        for c in ("semantic_score", "bm25_score", "keyword_score", "hybrid_score", "region_adjustment", "objective_score", "final_score"):
            assert r[c] == pytest.approx(every[r["q_id"], r["chunk_id"]][c], abs=1e-9), c
    for q in (1, 2):
        own = sorted((r for r in got if r["q_id"] == q), key=lambda r: r["rank"])
        assert [r["chunk_id"] for r in own] == sorted(range(5), key=lambda c: (-round(every[q, c]["final_score"], 9), -c))


def test_hybrid_search_of_nothing(spark):
    chunks, vectors, questions = chunk_rows(spark)
    assert retrieval.hybrid_search(chunks, vectors, questions.limit(0)).count() == 0
    assert retrieval.hybrid_search(chunks.limit(0), vectors, questions).count() == 0


def test_dense_ranks_keep_gaps(spark):
    chunks, _, _ = chunk_rows(spark)
    vectors = spark.createDataFrame([(0, [0.9]), (1, [0.1]), (2, [0.2]), (77, [0.5])], "chunk_id long, vector array<double>")
    got = retrieval.dense_retrieve(chunks, vectors, spark.createDataFrame([(1, [1.0])], "q_id long, vector array<double>"), k=4)
    assert sorted((r["rank"], r["chunk_id"]) for r in got.collect()) == [(1, 0), (3, 2)]


def test_many_questions_go_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    chunks = spark.createDataFrame([(i, "body", " ".join(rng.choice(["ant", "bee", "cat", "dog", "eel", "fox"], 5))) for i in range(40)], "chunk_id long, region string, text string")
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(40)], "chunk_id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, f"ant {'bee' if i % 2 else 'fox'}", [1.0, 0.0, float(i % 3), 1.0]) for i in range(23)], "q_id long, question string, vector array<double>")
    everything = lambda: [sorted(map(tuple, df.collect())) for df in (retrieval.similarities(vectors, asked, 4), retrieval.bm25(chunks, asked).select("q_id", "chunk_id", F.round("bm25", 9)), retrieval.hybrid_search(chunks, vectors, asked, 3).select("q_id", "rank", "chunk_id", F.round("final_score", 9)))]
    whole = everything()
    monkeypatch.setattr(retrieval, "MOST_QUESTIONS", 5)
    monkeypatch.setattr(retrieval, "ROWS_AT_ONCE", 3)
    assert everything() == whole and [len(x) for x in whole] == [23 * 4, len(whole[1]), 23 * 3]
    x = {r["chunk_id"]: r["vector"] for r in vectors.collect()}
    for r in asked.collect():
        brute = sorted((-float(np.dot(v, r["vector"])), c) for c, v in x.items())[:4]
        assert [(c, -s) for q, c, s, _ in sorted((t for t in whole[0] if t[0] == r["q_id"]), key=lambda t: t[3])] == [(c, s) for s, c in brute]


def test_integrity(spark):
    chunks, vectors, _ = chunk_rows(spark)
    good = embedding.integrity_report(chunks, vectors, 5)
    embedding.assert_integrity(good)
    bad = vectors.unionByName(spark.createDataFrame([(0, [1.0]), (99, None)], "chunk_id long, vector array<double>"))
    found = {r["check"]: r["violations"] for r in embedding.integrity_report(chunks, bad, 5).collect()}
    assert found["vector_without_chunk"] == 1 and found["duplicate_vector_id"] == 1 and found["wrong_dimension"] == 2
    with pytest.raises(ValueError, match="not sound"):
        embedding.assert_integrity(embedding.integrity_report(chunks, bad, 5))


def test_ocr_lines(spark):
    got = {r["line_id"]: r for r in ocr.select_lines(fx.LINES.spark(spark)).collect()}
    assert got[1]["engine"] == "paddle" and got[5]["engine"] == "paddle" and 4 not in got
    assert got[3]["engine"] == "uncertain" and got[3]["text"] == "" and got[3]["quality"] > 0
    boxes = spark.createDataFrame([([{"x": 1.9, "y": 2.0}, {"x": 8.7, "y": -3.5}],)], "polygon array<struct<x:double,y:double>>")
    assert tuple(ocr.polygon_boxes(boxes).select("x1", "y1", "x2", "y2").first()) == (1, -3, 8, 2)


def test_memory_by_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(12)] + [(2, 0, "user", "alone"), (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "")]
    turns = memory.answered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r["memory"] for r in memory.memory_context(turns).collect()}
    assert set(got) == {1} and got[1].count("User:") == 4 and got[1].startswith("User: m4\nAssistant: m5\n\n")


def test_citations(spark):
    got = {r["q_id"]: (r["answer"], r["cited"]) for r in evidence.repair_citations(fx.ANSWERS.spark(spark)).collect()}
    assert got[1][1] == [2] and got[2] == ("no cites\n\n[Source 1][Source 2]", [1, 2]) and got[3][1] == [1]
    assert got[4][1] == [1, 2] and got[5] == ("nothing", []) and got[6][1] == [1, 3]


def test_evaluation(spark):
    got = {r["name"]: r for r in evaluation.eval_terms(fx.CASES.spark(spark).filter("name NOT LIKE 'case %'")).collect()}
    assert got["a"]["matched"] == ["main objective", "real-time monitoring"] and not got["a"]["passed"]
    assert got["b"]["passed"] and got["e"]["score"] == 0.0
    total = evaluation.eval_summary(evaluation.eval_terms(fx.CASES.spark(spark).filter("name NOT LIKE 'case %'"))).first()
    assert (total["total"], total["n_passed"]) == (5, 2)


def test_visual_pages(spark):
    chunks = spark.createDataFrame(
        [(1, "a", 1, [], {"path": "r1"}), (2, "a", 1, [{"path": "e1"}], None), (3, "a", 1, [{"path": "e2"}], None), (4, "b", 1, [], {"path": "r2"}), (5, "b", 2, [], None)],
        "chunk_id long, source string, page int, images array<struct<path:string>>, page_image struct<path:string>",
    )
    apart = {(r["source"], r["page"]): r["path"] for r in visual.available_pages(chunks).collect()}
    assert apart == {("a", 1): "e2", ("b", 1): "r2"}
    assert [(r["page"], r["path"]) for r in visual.available_pages(chunks, by_source=False).collect()] == [(1, "e2")]


def test_files_that_fail_are_rows(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one\x0ctwo")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def reader(path, content):
        if content == b"bad":
            raise ValueError("cannot read")
        return [{"source": path.rsplit("/", 1)[-1], "page": i, "text": t.decode()} for i, t in enumerate(content.split(b"\x0c"), 1)]

    rows = src.read_files(src.find_files(spark, str(tmp_path)), reader).collect()
    assert sorted((r["page"] or 0, r["text"], r["error"]) for r in rows if not r["error"]) == [(1, "one", None), (2, "two", None)]
    assert [r["error"] for r in rows if r["error"]] == ["cannot read"]


def test_ingest_search_and_answer(spark, tmp_path):
    pages = [("a.pdf", 1, "Fish tanks need clean water. Sensors watch the water."), ("b.pdf", 1, "Trains run on steel rails. Stations have clocks.")]
    df = src.page_elements(spark.createDataFrame(pages, "source string, page int, text string").selectExpr("*", "false AS ocr_used", "CAST(NULL AS struct<path:string,width:int,height:int,dpi:int>) AS page_image", f"CAST(NULL AS array<{src.IMAGE}>) AS images", f"CAST(NULL AS array<{src.TABLE}>) AS tables"))
    src.write_table(df, f"{tmp_path}/elements")
    ingest(spark, f"{tmp_path}/elements", f"{tmp_path}/index")
    engine = Engine(spark, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, 7, "water sensors"), (2, 8, "steel rails")], "q_id long, conv_id long, question string")
    top = {r["q_id"]: r["source"] for r in engine.search(asked.select("q_id", "question"), k=1).collect()}
    assert top == {1: "a.pdf", 2: "b.pdf"}
    said = {r["q_id"]: r for r in engine.answer(asked).collect()}
    assert said[1]["answer"].startswith("Fish tanks") and said[1]["cited"] == [1]
    assert {r["source"] for r in engine.sources().collect()} == {"a.pdf", "b.pdf"}
    assert {r["chunk_id"] for r in engine.dense(asked).collect()} <= {0, 1}
    more = spark.createDataFrame([(3, 9, "compare the documents"), (4, 9, "picture of a tank on page 1"), (5, 9, "why is the water clean")], "q_id long, conv_id long, question string")
    got = {r["q_id"]: r for r in engine.answer(more, analyser=lambda prompt, path: f"seen {path}").collect()}
    assert {q: r["route"] for q, r in got.items()} == {3: "comparison", 4: "visual", 5: "fusion"}
    assert got[3]["answer"].startswith(evidence.NO_TEXT) and got[5]["cited"] == [1]
    turns = spark.createDataFrame([(7, 1, "what of rails", "steel rails and stations")], "conv_id long, turn long, question string, answer string")
    answered = engine.answer(asked, turns)
    assert {r["q_id"] for r in answered.collect()} == {1, 2}
    kept = {(r["conv_id"], r["turn"]): (r["question"], r["answer"]) for r in Engine.remember(turns, asked, answered).collect()}
    assert kept.keys() == {(7, 1), (7, 2), (8, 0)} and kept[7, 1][1] == "steel rails and stations"
    assert kept[7, 2][0] == "water sensors" and kept[8, 0][1].startswith("Trains")
    assert {r["source"] for r in engine.without("a.pdf")[0].collect()} == {"b.pdf"}


def test_index_takes_and_drops_documents(spark, tmp_path):
    def elements(name, rows):
        df = spark.createDataFrame(rows, "source string, page int, text string").selectExpr("*", "false AS ocr_used", "CAST(NULL AS struct<path:string,width:int,height:int,dpi:int>) AS page_image", f"CAST(NULL AS array<{src.IMAGE}>) AS images", f"CAST(NULL AS array<{src.TABLE}>) AS tables")
        src.write_table(src.page_elements(df), f"{tmp_path}/{name}")

    elements("one", [("a.pdf", 1, "Fish tanks need clean water."), ("b.pdf", 1, "Trains run on rails.")])
    elements("two", [("c.pdf", 1, "Ships sail the sea."), ("c.pdf", 2, "Ports have cranes.")])
    ingest(spark, f"{tmp_path}/one", f"{tmp_path}/index")
    engine = Engine(spark, f"{tmp_path}/index")
    engine.upload(f"{tmp_path}/two")
    engine.delete("a.pdf")
    again = Engine(spark, f"{tmp_path}/index")
    assert sorted((r["chunk_id"], r["source"]) for r in again.chunks.collect()) == [(1, "b.pdf"), (2, "c.pdf"), (3, "c.pdf")]
    assert sorted(r["chunk_id"] for r in again.vectors.collect()) == [1, 2, 3]
    asked = spark.createDataFrame([(1, "ships at sea")], "q_id long, question string")
    assert again.search(asked, k=1).first()["source"] == "c.pdf"


def test_memory_keeps_answers_without_appended_citations(spark):
    rows = spark.createDataFrame([(1, "said [Source 1]", 2), (2, "bare", 2)], "q_id long, answer string, n_sources int").withColumn("spoken", F.col("answer"))
    got = {r["q_id"]: (r["answer"], r["spoken"]) for r in evidence.repair_citations(rows, ("spoken",)).collect()}
    assert got == {1: ("said [Source 1]", "said [Source 1]"), 2: ("bare\n\n[Source 1][Source 2]", "bare")}


def test_comparison_reads_the_first_image_of_every_document(spark, tmp_path):
    element = "source string, page int, text string, ocr_used boolean, page_image struct<path:string,width:int,height:int,dpi:int>"
    rows = [("a.pdf", 2, "", False, ("a2.png", 1, 1, 1)), ("a.pdf", 1, "", False, ("a1.png", 1, 1, 1)), ("b.pdf", 1, "A text that is long enough to be quoted when documents are put side by side, surely.", False, None)]
    df = src.page_elements(spark.createDataFrame(rows, element).selectExpr("*", f"CAST(NULL AS array<{src.IMAGE}>) AS images", f"CAST(NULL AS array<{src.TABLE}>) AS tables"))
    src.write_table(df, f"{tmp_path}/elements")
    ingest(spark, f"{tmp_path}/elements", f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, 1, "Compare the documents")], "q_id long, conv_id long, question string")
    looked = Engine(spark, f"{tmp_path}/index").answer(asked, answerer=lambda q, context: context, analyser=lambda prompt, path: f"saw {path}").first()["answer"]
    assert "saw a1.png" in looked and "a2.png" not in looked and evidence.NO_IMAGE in looked and evidence.NO_TEXT in looked


def test_pages_without_source_or_number_keep_their_chunks(spark):
    pages = spark.createDataFrame([("s", 1, "One."), (None, 2, "Two."), ("s", None, "Three."), (None, None, "Four.")], "source string, page int, text string")
    pages = pages.selectExpr("*", "true AS ocr_used", "'eng' AS ocr_languages", "80.0D AS ocr_confidence", "false AS has_visual_content", "CAST(NULL AS struct<path:string>) AS page_image", f"CAST(NULL AS array<{src.IMAGE}>) AS images", f"CAST(NULL AS array<{src.TABLE}>) AS tables")
    got = chunking.page_chunks(pages).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["source"], r["page"], r["text"]) for r in got] == [(0, "Unknown", 0, "Four."), (1, "Unknown", 2, "Two."), (2, "s", 0, "Three."), (3, "s", 1, "One.")]
    assert {(r["ocr_languages"], r["ocr_confidence"], r["ocr_quality"], r["image_count"], r["table_count"], r["section"]) for r in got} == {("eng", 80.0, 0.0, 0, 0, "Unknown")}
    rows = spark.createDataFrame([(None, 5, 1), ("a", None, 1), (None, None, 2), ("a", 3, 1)], "g string, page int, k int")
    assert sorted(r["id"] for r in src.dense_ids(rows, ["g", "page", "k"], "id", "page").collect()) == [0, 1, 2, 3]


def test_streaming_ingest_takes_each_file_once(spark, tmp_path):
    src_dir, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    rows = lambda page: spark.createDataFrame([("s", page, f"Page {page} text. More.")], "source string, page int, text string")
    for page in (1, 2):
        rows(page).write.mode("append").parquet(src_dir)
        query = start_ingest(spark, src_dir, out, mark)
        query.awaitTermination(120)
    assert sorted(r["page"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_visual_answers_keep_numbers_with_gaps(spark):
    rows = [(1, "see [Visual Source 3] and [Visual Source 2]", [1, 3]), (2, "nothing", [2]), (3, "no image", [])]
    got = {r["q_id"]: (r["answer"], r["cited_visual"]) for r in evidence.repair_visual(spark.createDataFrame(rows, "q_id long, answer string, numbers array<int>")).collect()}
    assert got[1][1] == [3] and got[2] == ("nothing\n\n[Visual Source 2]", [2]) and got[3] == ("no image", [])


def test_readers_of_manifests_and_blocks(spark, tmp_path):
    import json

    (tmp_path / "m.json").write_text(json.dumps({"documents": [{"source": "a", "page_count": 1, "pages": [{"page": 1, "text": "x"}, {"page": 2, "source": "own"}]}]}))
    assert sorted((r["source"], r["page"]) for r in src.read_documents(spark, f"{tmp_path}/m.json").collect()) == [("a", 1), ("own", 2)]
    (tmp_path / "b.json").write_text(json.dumps([{"text": "t"}, {"region": "header", "page": 3}]))
    assert sorted((r["region"], r["page"]) for r in src.read_blocks(spark, f"{tmp_path}/b.json").collect()) == [("body", 0), ("header", 3)]

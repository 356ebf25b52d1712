"""Results of recognised pages: counts, text, and the JSON they are written as."""

from pathlib import Path

from pyspark.sql import functions as F

from folioscope.operators import ocr
from folioscope.sources import pages as src

LINES = "source string, line_id long, engine string, language string, text string, confidence double, quality double"


def test_page_results_round_trip(spark, tmp_path):
    rows = [
        ("scan 1.png", 2, "tesseract", "latin", "second", 0.5, 0.7), ("scan 1.png", 1, "paddle", "latin", "first", 0.9, 0.8), ("scan 1.png", 3, "uncertain", "hindi", "", 0.2, 0.1),
        ("b.png", 1, "uncertain", "latin", "", 0.1, 0.2),
    ]
    boxes = [(1, [{"x1": 0, "y1": 0, "x2": 50, "y2": 10}, {"x1": 60, "y1": 2, "x2": 90, "y2": 12}, {"x1": 0, "y1": 0, "x2": 7, "y2": 10}, {"x1": 5, "y1": 30, "x2": 70, "y2": 40}]), (2, []), (3, None)]
    counts = ocr.detection_counts(spark.createDataFrame(boxes, "page long, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>"))
    assert sorted(map(tuple, counts.collect())) == [(1, 4, 3, 2), (2, 0, 0, 0), (3, 0, 0, 0)]
    known = counts.filter("page = 1").select(F.lit("scan 1.png").alias("source"), *ocr.COUNTS)
    made = ocr.page_results(spark.createDataFrame(rows, LINES), known)
    got = {r["source"]: r for r in made.collect()}
    one = got["scan 1.png"]
    assert one["text"] == "first\nsecond" and [x["line_id"] for x in one["lines"]] == [1, 2, 3]
    assert [one[c] for c in (*ocr.COUNTS, "ocr_line_count", "accepted_line_count", "paddle_selected", "tesseract_selected", "uncertain_line_count")] == [4, 3, 2, 3, 2, 1, 1, 1]
    assert (one["average_confidence"], one["average_quality"]) == (0.7, 0.75)
    assert got["b.png"]["text"] == "" and got["b.png"]["average_quality"] == 0.0 and got["b.png"]["raw_detection_count"] is None
    for _ in range(2):  # written again, the same is there
        src.write_page_results(made, f"{tmp_path}/ocr")
    assert {p.name for p in Path(tmp_path, "ocr").glob("file=*")} == {"file=scan_1_hybrid", "file=b_hybrid"}
    back = src.read_page_results(spark, f"{tmp_path}/ocr", ocr.PAGE_RESULT)
    assert {r["source"]: r.asDict(True) for r in back.collect()} == {s: r.asDict(True) for s, r in got.items()}

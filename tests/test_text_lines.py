"""Lines of boxes made where pages are, against the grouped boxes and their unions."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import ocr

BOX = "page long, id int, x1 int, y1 int, x2 int, y2 int"


def slow_lines(boxes, overlap=0.35, gap=3.0):
    lines = []
    for i, x1, y1, x2, y2 in sorted(boxes, key=lambda b: (b[2], b[1], b[0])):
        best, most = None, -1.0
        for line in lines:
            shared = max(0, min(y2, max(b[4] for b in line)) - max(y1, min(b[2] for b in line)))
            part = shared / min(max(1, y2 - y1), max(1, max(b[4] for b in line) - min(b[2] for b in line)))
            tall = sum(max(1, b[4] - b[2]) for b in line) / len(line)
            if part >= overlap and part > most and max(0, x1 - max(b[3] for b in line)) <= gap * tall:
                best, most = line, part
        if best is None:
            lines.append([(i, x1, y1, x2, y2)])
        else:
            best.append((i, x1, y1, x2, y2))
    return sorted(lines, key=lambda line: min(b[2] for b in line))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_lines_of_many_pages(spark, monkeypatch, batch):
    monkeypatch.setattr(ocr, "ROWS_OUT", 5)
    rng, pages, rows = random.Random(2), {}, []
    for page in [None, 0, -5, *range(7, 47)]:
        for i in range(rng.randrange(1, 40)):
            x, y = rng.randrange(0, 300), rng.randrange(0, 120)
            pages.setdefault(page, []).append((i, x, y, x + rng.randrange(8, 60), y + rng.randrange(5, 25)))
        rows += [(page, *b) for b in pages[page]]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, BOX).repartition(5)
        got = sorted(map(tuple, ocr.text_lines(df).collect()), key=str)
        assert got == sorted(map(tuple, ocr.line_boxes(ocr.group_lines(df)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for page, boxes in pages.items():
        for n, line in enumerate(slow_lines(boxes)):
            ids = ",".join(str(i) for i in sorted(b[0] for b in line))
            want.append((page, n, *[f(b[k] for b in line) for k, f in ((1, min), (2, min), (3, max), (4, max))], ids))
    assert got == sorted(want, key=str)


def test_lines_of_a_recogniser_are_split_once(spark):
    lines = spark.createDataFrame([(1, i, "\t".join(["5"] * 10 + [c, w])) for i, (c, w) in enumerate([("80", " a "), ("-1", "b"), ("x", "c"), ("90.5", "d"), ("70", " ")])], "key long, line_no int, line string").repartition(2)
    df = ocr.parse_tsv(lines.unionByName(spark.createDataFrame([(2, 0, "1\t2")], lines.schema)))
    assert [tuple(r) for r in df.collect()] == [(1, "a d", 85.25)]
    assert ocr.parse_tsv(lines)._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_text_lines_shuffle_boxes_once(spark):
    df = ocr.text_lines(spark.createDataFrame([(1, 0, 0, 0, 20, 10)], BOX).withColumn("page", F.col("page") + 1))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1

"""Characters of lines are counted once for all scores that need them, and by runs."""

from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import ocr
from jobs import ingest_documents


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_are_made_once_a_line(spark):
    rows = spark.createDataFrame([(1, 0, "paddle", "latin", "abc 12", 0.9)], "line_id long, ord int, engine string, language string, text string, confidence double").repartition(2)
    for df in (ocr.select_lines(rows), ocr.score_lines(rows).filter("valid")):
        assert optimized(df).count("[^A-Za-z]+") == 1
    documents = spark.createDataFrame([(1, "abc 12", "en", "a")], ingest_documents.INPUT).repartition(2)
    assert optimized(ingest_documents.judged(documents, 40).filter("script = 'latin'")).count("[^A-Za-z]+") == 1


def test_counts_by_runs(spark):
    texts = ["", None, " \t\n 　 \u0085", "Ab9 éß中!", "अआ ಅ x\U0001f600\U0001f600-1", "a1b2अ3ಅ4 ..", "12\n34"]
    counts = text.script_counts(F.col("text"))
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").orderBy("id").select(*counts.values()).collect()]
    kinds = [lambda c: "a" <= c.lower() <= "z" and c.isascii(), lambda c: "ऀ" <= c <= "ॿ", lambda c: "ಀ" <= c <= "೿", lambda c: "0" <= c <= "9"]
    want = []
    for t in texts:
        seen = [c for c in t or "" if not c.isspace()]
        found = [sum(map(k, seen)) for k in kinds]
        want.append((*found, len(seen) - sum(found)))
    assert list(counts) == ["latin", "hindi", "kannada", "digits", "other"]
    assert got == want

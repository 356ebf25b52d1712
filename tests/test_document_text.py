"""The text of a source is whole, however many ranges of pages it has."""

from folioscope.sources import pages


def test_one_text_a_source(spark):
    rows = [("a", 2500, "z"), ("a", 1, "x"), ("a", 999, None), ("a", 1000, "y\n"), ("b", 7, ""), ("a", None, "no number"), (None, 3, "w"), ("c", None, "q")]
    df = pages.document_text(spark.createDataFrame(rows, "source string, page int, text string").repartition(3))
    mark = lambda n, t: f"\n--- Page {n} ---\n{t}"
    want = {"a": "\n".join([mark(1, "x"), mark(999, ""), mark(1000, "y\n"), mark(2500, "z")]), "b": mark(7, ""), None: mark(3, "w"), "c": ""}
    assert df.columns == ["source", "text"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.items(), key=str)

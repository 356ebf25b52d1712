"""Documents compared in one prompt or, if they are many, in groups of groups."""

import pytest

from folioscope.operators import evidence


def documents(spark, n):
    return spark.createDataFrame([(i + 1, f"d{i + 1}.pdf", f"text {i + 1}", "none") for i in range(n)], "number int, source string, text string, visual string").repartition(3)


def names(question, context):
    """Says which documents or parts it was shown, in order."""
    if question == "fail" and "[Document 4]" in context:
        raise ValueError("no answer")
    out = []
    for piece in context.split("["):
        if piece.startswith("Document"):
            out.append(piece.split("]")[0].removeprefix("Document "))
        elif piece.startswith("Part"):
            out.append(piece.split("Evidence:\n")[1].strip())
    return "(" + " ".join(out) + ")"


@pytest.mark.parametrize(("n", "want"), [(1, "(1)"), (3, "(1 2 3)"), (4, "((1 2 3) (4))"), (10, "(((1 2 3) (4 5 6) (7 8 9)) ((10)))"), (0, None)])
def test_groups_of_groups(spark, n, want):
    asked = spark.createDataFrame([(7, "which"), (8, "which"), (9, "fail")], "q_id long, question string")
    got = {r["q_id"]: (r["answer"], r["error"]) for r in evidence.compare_documents(asked, documents(spark, n), names, most=3).collect()}
    if want is None:
        assert got == {}
        return
    assert got[7] == got[8] == (want, None)
    assert got[9] == ((want, None) if n < 4 else (want.replace("(4 5 6)", evidence.FAILED).replace("(4)", evidence.FAILED), None))


def test_numbers_follow_the_first_chunk(spark):
    rows = [(c, s, 1, "body", "text", t) for c, s, t in ((5, "b", "x" * 90), (2, "a", "short"), (9, "a", "y" * 100), (7, "c", None), (1, "", "z" * 99))]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, page int, region string, content_type string, text string")
    got = [(r["number"], r["source"]) for r in sorted(evidence.doc_compare_context(chunks).collect(), key=lambda r: r["number"])]
    assert got == [(1, "a"), (2, "b"), (3, "c")]

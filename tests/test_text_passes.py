"""Texts are cleaned, judged and split in few passes, with the results of the rules as they are written."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from jobs import ingest_documents

SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PIECES = [
    "e.g.", "i.e. ", "E.G. ", "Dr. ", "dr.\n", "xDr. ", "_vs. ", "éetc. ", "etc.", "approx.\u2028", "e.g.etc. ", "i.e.g. ", "vs. vs. ", "a-\nb", "é-\nç", "-\n", "x - \ny", "\r\n", "\r", "\n\n\n", "\n", "\t", "  ", " ",
    "\xa0", "\u3000", "\u180e", "\u200b", "\x1c", "\x0b", "\x01", "<DOT>", "<DOT> ", ".", "!", "?", "...", "! ", "3.14 ", "abc", "Z", "अ", "ಅ", "\u06f3", "7", "\U0001f600", "h", "k", "d", "$1", "\\",
]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def bare(s):
    return re.sub(rf"\A{SPACE}+|{SPACE}+\Z", "", s)


def cleaned(s):
    s = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", s))
    return bare(re.sub("\r\n|\r", "\n", re.sub(r"(\w+)-\n(\w+)", r"\1\2", s)))


def parted(s):
    s = re.sub(rf"\b(e\.g|i\.e|etc|Dr|Mr|Mrs|Ms|Fig|Eq|approx|vs)\.(?={SPACE})", r"\1<DOT>", cleaned(s), flags=re.I)
    parts = re.sub(rf"([.!?]){SPACE}+", "\\1\x01", s).split("\x01")
    return [p for p in (bare(p.replace("<DOT>", ".")) for p in parts) if p]


def test_results_of_the_rules(spark):
    draw = random.Random(3)
    texts = ["", " \n", *("".join(draw.choices(PIECES, k=draw.choice((1, 2, 4, 9, 30)))) for _ in range(3000))]
    t = F.col("text")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("text", text.strip(t), text.clean_chunk(t), text.sentences(t)).collect()
    for r in rows:
        assert tuple(r[1:]) == (bare(r[0]), cleaned(r[0]), parted(r[0])), repr(r[0])
    assert spark.range(1).select(text.strip(F.lit(None).cast("string")), text.clean_chunk(F.lit(None).cast("string"))).first() == (None, "")


@pytest.mark.parametrize("rows", [ingest_documents.page_rows, lambda d: ingest_documents.chunk_rows(d, ingest_documents.read_config())])
def test_documents_are_judged_in_few_passes(spark, rows):
    documents = spark.createDataFrame([(1, "abc 12", "en", "a")], ingest_documents.INPUT).repartition(2)
    plan = optimized(rows(ingest_documents.judged(documents, 40)))
    assert plan.count(" translate(") + plan.count("(translate(") == 1  # characters are looked at once for all scripts
    assert r"(?U)^\s+|\s+$" not in plan

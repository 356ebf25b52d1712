"""Small literal tables for operators whose inputs the driver's tables lack.

Each is built twice from the same rows: as a DataFrame and as DuckDB SQL.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.lexicons import DomainPack


def literal(x) -> str:
    """A Python value as DuckDB SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"'{k}': {literal(v)}" for k, v in x.items()) + "}"
    return repr(x)


class Fixture:
    def __init__(self, schema: str, rows: list[tuple], sql_types: dict[str, str] | None = None):
        self.schema, self.rows, self.types = schema, rows, sql_types or {}

    def spark(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self, spark_names: list[str]) -> str:
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        simple = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        kinds = {c: simple[t] for c, t in re.findall(r"(?:^|, )(\w+) (\w+)(?=,|$)", self.schema) if t in simple} | self.types
        cols = ", ".join(f"CAST({c} AS {kinds[c]}) AS {c}" if c in kinds else c for c in spark_names)
        return f"(SELECT {cols} FROM (VALUES {values}) AS t({', '.join(spark_names)}))"


TEXTS = Fixture(
    "id long, text string",
    [
        (1, "ab-\ncd-\nef"), (2, "a\r\nb\rc"), (3, "x  \t y\n\n\n\nz "), (4, None), (5, "See Fig. 3 vs. it. End."), (6, "A b. C d!  E? F 0.5 x"), (7, ""), (8, "e.g. this, i.e. that. Dr. No etc. goes. approx. 3 Eq. 4"),
        (9, "Été 0.9593, 1,000 a.b.c café!"), (10, "word " * 150 + "end. short one. " + "more " * 60 + "stop."), (11, "under_score \\ back"), (12, "1.2.3 a. b"),
    ],
)
SCRIPTS = Fixture(
    "id long, text string, confidence double, language string",
    [(1, "été 1!", 0.9, "latin"), (2, "कखग ab", 0.5, "hindi"), (3, "ಕನ್ನಡ", 0.7, "kannada"), (4, "42", 0.1, "latin"), (5, "!!", 0.9, "latin"), (6, "", 0.9, "latin"), (7, "क", 0.9, "hindi"), (8, "plain words here", 0.25, "latin"), (9, "ab", 0.19, "other"), (10, None, 0.5, "latin")],
)
QUESTIONS = Fixture(
    "q_id long, question string",
    [
        (1, "Say how the picture of page 1 looks"), (2, "See page 3 and p. 4"), (3, "p.7"), (4, "pg 9"), (5, "Page12"), (6, "table did show"), (7, "Table iv"), (8, "table 7 values"), (9, "Who wrote the paper?"), (10, "What is the main objective?"),
        (11, "Compare the documents"), (12, "Give the email of the department"), (13, "the sensors of the system"), (14, "hello there"), (15, "xgboost cross-validation 0.9593"), (16, "What does HAISAS do?"), (17, "picture of a cat"), (18, "columns of data"), (19, ""), (20, "growth claims"),
    ],
)
_R = "array<array<string>>"
ELEMENTS = Fixture(
    f"source string, page int, text string, ocr_used boolean, ocr_confidence double, ocr_quality double, page_image struct<path:string>, images array<struct<path:string,width:int,height:int,extension:string>>, tables array<struct<rows:{_R}>>, has_visual_content boolean",
    [
        ("a.pdf", 1, "One two three. Four five.", False, 0.0, 0.0, {"path": "a_1.png"}, [{"path": "i1.png", "width": 10, "height": 20, "extension": "png"}], [{"rows": [["h", "v"], ["a", None]]}], True),
        ("a.pdf", 2, "", True, 81.5, 0.4, {"path": "a_2.png"}, [], [], True),
        ("a.pdf", 3, None, False, 0.0, 0.0, None, [], [{"rows": [[None, None], [""], ["a", None]]}, {"rows": []}, {"rows": [["x"]]}], False),
        ("b c.pdf", 1, "word " * 100 + "end. tail here.", True, 60.0, 0.7, None, [{"path": "", "width": 0, "height": 5, "extension": None}, {"path": "i2.jpg", "width": None, "height": None, "extension": "jpg"}], [], True),
    ],
    {"page_image": "STRUCT(path VARCHAR)", "images": "STRUCT(path VARCHAR, width INTEGER, height INTEGER, extension VARCHAR)[]", "tables": "STRUCT(rows VARCHAR[][])[]", "text": "VARCHAR"},
)
LOOSE_PAGES = Fixture(
    "source string, page int, text string, ocr_used boolean, ocr_languages string, ocr_confidence double",
    [(None, 4, "No source here. A second sentence.", None, "eng", None), ("a.pdf", None, "No page number.", False, "eng", 0.0), (None, None, "Neither of them.", True, "eng+hin", 71.5), (None, None, None, True, None, None)],
)
CANDIDATES = Fixture(
    "key long, ord int, text string, confidence double, quality double",
    [(1, 0, "x" * 60, 80.0, 0.5), (1, 1, "y" * 20, 99.0, 0.9), (1, 2, "z" * 55, 70.0, 0.5), (2, 0, "short", 50.0, 0.1), (2, 1, "other", 60.0, 0.2), (3, 0, "", 99.0, 0.9)],
)
LINES = Fixture(
    "line_id long, ord int, engine string, language string, text string, confidence double",
    [(1, 0, "paddle", "latin", "Hello world", 0.9), (1, 1, "paddle", "hindi", "Hello world", 0.8), (1, 2, "tesseract", "latin", "Hello w0rld", 0.9), (2, 0, "paddle", "hindi", "कखग", 0.5), (3, 0, "paddle", "latin", "a!!!", 0.21), (4, 0, "paddle", "kannada", "ab", 0.9), (5, 0, "paddle", "latin", "tie tie", 0.5), (5, 1, "tesseract", "latin", "tie tie", 0.5)],
)
BOXES = Fixture(
    "page long, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>",
    [(1, [{"x1": 0, "y1": 0, "x2": 50, "y2": 10}, {"x1": 60, "y1": 2, "x2": 90, "y2": 12}, {"x1": 0, "y1": 0, "x2": 7, "y2": 10}, {"x1": 5, "y1": 30, "x2": 70, "y2": 40}, {"x1": 400, "y1": 31, "x2": 450, "y2": 41}, {"x1": 0, "y1": 0, "x2": 40, "y2": 4}]), (2, [{"x1": 1, "y1": 1, "x2": 9, "y2": 6}])],
)
ANSWERS = Fixture(
    "q_id long, answer string, n_sources int",
    [(1, "It is [Source 2][source 2] [Source 9] [Visual Source 1] [Source 1, Source 2]", 3), (2, "no cites", 3), (3, "no cites", 1), (4, "[Source 0] [Source 4]", 3), (5, "nothing", 0), (6, "[Source  3] and [SOURCE 1]", 3)],
)
CASES = Fixture(
    "name string, category string, answer string, expected_terms array<string>",
    [("a", "text", "The  main_objective is real-time\\monitoring", ["main objective", "real-time monitoring", "absent"]), ("b", "text", "alpha beta", ["ALPHA", "beta"]), ("c", "table", "nothing", ["x", "y"]), ("d", "table", "xy", ["x", "y"]), ("e", "memory", "any", [])],
    {"expected_terms": "VARCHAR[]"},
)
TSV = Fixture(
    "key long, line_no int, line string",
    [(1, 0, "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"), (1, 1, "5\t1\t1\t1\t1\t1\t0\t0\t1\t1\t96.5\tHello"), (1, 2, "5\t1\t1\t1\t1\t2\t0\t0\t1\t1\t-1\tskip"), (1, 3, "5\t1\t1\t1\t1\t3\t0\t0\t1\t1\t80\t world "), (1, 4, "5\t1\t1"), (2, 0, "5\t1\t1\t1\t1\t1\t0\t0\t1\t1\t10\t ")],
)
BLOCKS = Fixture(
    "source string, page int, region string, section string, subsection string, text string",
    [
        ("p", 1, "header", None, None, "Title of it. By A. Author."), ("p", 1, "abstract", "Abstract", None, "We do x. Then y."), ("p", None, None, "Intro", "Aims", "Body one. Body two!"), ("p", 2, "body", "x", "y", " "), ("q", 3, "body", "Methods", "Data", "word " * 95 + "stop. tail."),
        (None, 3, "header", "Methods", None, "No source."),
    ],
)
SIZES = Fixture("id long, width int, height int", [(1, 1700, 1100), (2, 400, 300), (3, 850, 2200), (4, 1, 5000), (5, 1000, 1000)])



def _more(fixture: Fixture, seed: int, n: int, make: Callable[[random.Random, int], list[tuple]]) -> None:
    """Rows made by rule from a seeded generator, beside the literal ones."""
    rng = random.Random(seed)
    for i in range(n):
        fixture.rows += make(rng, 1_000 + i)


_WORDS = {"latin": "the cat Été naïve reads 12 books; fast! (or) not? x-y".split(), "hindi": "कखग नमस्ते ab १२ है! क".split(), "kannada": "ಕನ್ನಡ ನಮಸ್ಕಾರ 7 ab ಕ, !!".split()}


def _line(rng: random.Random, most: int = 9) -> tuple[str, str]:
    """(language, text): words of a language, now and then of another."""
    language = rng.choice(sorted(_WORDS))
    pool = _WORDS[language] * 3 + _WORDS[rng.choice(sorted(_WORDS))] + ["", "!!!", "w0rld"]
    return language, " ".join(rng.choice(pool) for _ in range(rng.randrange(most)))


def _scripts(rng: random.Random, i: int) -> list[tuple]:
    language, text = _line(rng)
    return [(i, rng.choice([text, text, text, None]), rng.randrange(0, 101) / 100, rng.choice([language, language, "latin", "other"]))]


def _lines(rng: random.Random, i: int) -> list[tuple]:
    return [(i, k, rng.choice(["paddle", "tesseract"]), language, text, rng.randrange(0, 101) / 100) for k in range(rng.randrange(1, 5)) for language, text in [_line(rng)]]


def _candidates(rng: random.Random, i: int) -> list[tuple]:
    return [(i, k, rng.choice("abc") * rng.choice([0, 20, 49, 50, 51, 80]), float(rng.randrange(101)), rng.randrange(5) / 4) for k in range(rng.randrange(1, 6))]


def _answers(rng: random.Random, i: int) -> list[tuple]:
    parts = ["text", "[Source 1]", "[source 2]", "[SOURCE  3]", "[Source 12]", "[Source 0]", "[Visual Source 1]", "[Source x]", "[Source 2, Source 3]"]
    return [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(6))), rng.randrange(5))]


def _cases(rng: random.Random, i: int) -> list[tuple]:
    terms = ["main objective", "ALPHA", "beta", "real-time", "a_b", "x y", "absent"]
    answer = " ".join(rng.choice(["the main_objective", "alpha", "Beta", "real-time", "a b", "x\\y", "nothing"]) for _ in range(rng.randrange(1, 6)))
    return [(f"case {i}", rng.choice(["text", "table", "memory", "visual"]), answer, rng.sample(terms, rng.randrange(1, 5)))]


_more(SCRIPTS, 1, 1_000, _scripts)
_more(LINES, 2, 600, _lines)
_more(CANDIDATES, 3, 600, _candidates)
_more(ANSWERS, 4, 1_000, _answers)
_more(CASES, 5, 500, _cases)
_more(SIZES, 6, 1_000, lambda rng, i: [(i, rng.randrange(1, 4_000), rng.randrange(1, 4_000))])

# The pack of the subject that the original questions are about.
DOMAIN_PACK = DomainPack(
    technical=("xgboost", "random forest"),
    objective_terms=("automated control", "fish health", "aquaponics"),
    expansions=(
        (("haisas",), " Hybrid AI IoT Smart Aquaponics System"),
        (None, " objective purpose aim goal real-time monitoring fish health prediction automated control integrated framework aquaponics"),
        (("0.9593", "cross-validation", "cross validation"), " Random Forest RFC highest cross-validation score 0.9593"),
        (("xgboost",), " XGBoost test accuracy macro F1 98% 0.94"),
    ),
)

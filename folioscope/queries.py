"""Registered queries of the engine's own operators, with their DuckDB counterparts.

The driver's tables feed every operator, whole, directly or by way of rows that
:mod:`.derived` makes of them; a few literal edge cases stand beside those.  ``documents``
are single pages and chunks (chunk_id = page = doc_id), ``benchmark`` texts are
questions, and ``embeddings`` are paired with documents and questions by id (a
synthetic pairing: it tests the computation, not relevance).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived
from . import fixtures as fx
from .derived import table
from .functions import lexicons as lex
from .functions import routing, text
from .operators import chunking, embedding, evaluation, evidence, memory, ocr, phrases, retrieval, visual
from .operators.inverted import InvertedIndex
from .operators.vector_index import VectorIndex
from .plans import evaluate
from .sources import pages as src
from .sources.store import new_folder
from .streaming import memory as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ SQL pieces
# RE2 escapes go into DuckDB literals as they are.

L = r"[\p{L}\p{N}_]"


def s_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def s_clean_ingest(x: str) -> str:
    x = rf"regexp_replace(coalesce({x}, ''), '\r\n|\r', chr(10), 'g')"
    x = rf"regexp_replace({x}, '({L})-\n({L})', '\1\2', 'g')"
    return s_strip(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def s_clean_chunk(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    x = rf"regexp_replace({x}, '({L}+)-\n({L}+)', '\1\2', 'g')"
    return s_strip(rf"regexp_replace({x}, '\r\n|\r', chr(10), 'g')")


def s_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


def s_sentences(x: str) -> str:
    x = rf"regexp_replace({s_clean_chunk(x)}, '(\d)\.(\d)', '\1<DOT>\2', 'g')"
    for a, b in (("e", "g"), ("i", "e")):
        x = rf"regexp_replace({x}, '(?i)\b({a})\.({b})\.', '\1<DOT>\2<DOT>', 'g')"
    x = rf"regexp_replace({x}, '(?i)\b(etc|Dr|Mr|Mrs|Ms|Fig|Eq|approx|vs)\.', '\1<DOT>', 'g')"
    x = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({x}, lambda s: {s_strip(chr(39).join(['replace(s, ', '<DOT>', ', ', '.', ')']))}), lambda s: s <> '')"


def s_packs(x: str, merge: bool = True) -> str:
    """The greedy folds as reductions over one-element lists."""

    def fold(items: str, joins: str) -> str:
        join = "list_concat(a[1:len(a) - 1], [{'text': a[len(a)].text || ' ' || b[1].text, 'n': a[len(a)].n + b[1].n}])"
        return f"(CASE WHEN len({items}) = 0 THEN [] ELSE list_reduce({items}, lambda a, b: CASE WHEN {joins} THEN {join} ELSE list_concat(a, b) END) END)"

    items = f"list_transform({x}, lambda u: [{{'text': u, 'n': len({s_words('u')})}}])"
    packed = fold(items, "a[len(a)].n + b[1].n <= 90")
    return fold(f"list_transform({packed}, lambda p: [p])", "b[1].n < 40 AND a[len(a)].n + b[1].n <= 140") if merge else packed


def s_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{text.TOKEN}')"


def s_any(x: str, phrases: tuple[str, ...]) -> str:
    return f"list_bool_or(list_transform({fx.literal(list(phrases))}, lambda p: contains({x}, p)))"


def s_script(x: str) -> dict[str, str]:
    bare = rf"regexp_replace(coalesce({x}, ''), '\s+', '', 'g')"
    kinds = {"latin": "A-Za-z", "hindi": "ऀ-ॿ", "kannada": "ಀ-೿", "digits": "0-9"}
    out = {k: f"length(regexp_replace({bare}, '[^{v}]', '', 'g'))" for k, v in kinds.items()}
    return out | {"other": f"length(regexp_replace({bare}, '[{''.join(kinds.values())}]', '', 'g'))"}


TEXTS = fx.TEXTS.sql(["id", "text"])
SCRIPTS = fx.SCRIPTS.sql(["id", "text", "confidence", "language"])
QUESTIONS = fx.QUESTIONS.sql(["q_id", "question"])
ELEMENT_COLUMNS = ["source", "page", "text", "ocr_used", "ocr_confidence", "ocr_quality", "page_image", "images", "tables", "has_visual_content"]
ELEMENTS = fx.ELEMENTS.sql(ELEMENT_COLUMNS)
ALL_TEXTS = f"(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM {TEXTS})"
ALL_QUESTIONS = f"(SELECT item_id AS q_id, text AS question FROM benchmark UNION ALL SELECT -q_id, question FROM {QUESTIONS})"


def all_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the literal edge cases (negative ids)."""
    own = fx.TEXTS.spark(spark).select((-F.col("id")).alias("id"), "text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(own)


def all_questions(spark: SparkSession, d: str) -> DataFrame:
    own = fx.QUESTIONS.spark(spark).select((-F.col("q_id")).alias("q_id"), "question")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question")).unionByName(own)


# ------------------------------------------------------------------ text


@query(f"SELECT id, {s_clean_ingest('text')} AS cleaned FROM {ALL_TEXTS}")
def clean_ingest(spark, d):
    return all_texts(spark, d).select("id", text.clean_ingest(F.col("text")).alias("cleaned"))


@query(f"SELECT id, {s_clean_chunk('text')} AS cleaned FROM {ALL_TEXTS}")
def clean_chunk(spark, d):
    return all_texts(spark, d).select("id", text.clean_chunk(F.col("text")).alias("cleaned"))


@query(rf"SELECT id, {s_strip(r"regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')")} AS cleaned FROM {ALL_TEXTS}")
def normalize_ws(spark, d):
    return all_texts(spark, d).select("id", text.normalize_ws(F.col("text")).alias("cleaned"))


@query(rf"SELECT id, {s_strip(r"regexp_replace(coalesce(translate(lower(text), '_\', '  '), ''), '\s+', ' ', 'g')")} AS cleaned FROM {ALL_TEXTS}")
def normalize_eval(spark, d):
    return all_texts(spark, d).select("id", text.normalize_eval(F.col("text")).alias("cleaned"))


@query(f"SELECT id, CAST(i - 1 AS INTEGER) AS sentence, s[i] AS text FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, {s_sentences('text')} AS s FROM {ALL_TEXTS}))")
def sentences(spark, d):
    return all_texts(spark, d).select("id", F.posexplode_outer(text.sentences(F.col("text"))).alias("sentence", "text")).filter("sentence IS NOT NULL")


@query(f"SELECT id, CAST(len({s_words('text')}) AS INTEGER) AS n_words FROM {ALL_TEXTS}")
def word_counts(spark, d):
    return all_texts(spark, d).select("id", text.word_count(F.col("text")).alias("n_words"))


@query(f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({s_tokens('text')}) AS term FROM {ALL_TEXTS}) GROUP BY id, term")
def tokens(spark, d):
    return retrieval.postings(all_texts(spark, d).withColumnRenamed("id", "chunk_id")).withColumnRenamed("chunk_id", "id")


SCRIPT_INPUT = f"(SELECT id, text, confidence, language FROM {SCRIPTS} UNION ALL SELECT -1 - doc_id, text, (doc_id % 101) / 100.0, 'latin' FROM documents)"


def script_input(spark, d):
    own = table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("id"), "text", ((F.col("doc_id") % 101) / 100.0).alias("confidence"), F.lit("latin").alias("language"))
    return fx.SCRIPTS.spark(spark).unionByName(own)


@query(f"SELECT id, {', '.join(f'CAST({v} AS INTEGER) AS n_{k}' for k, v in s_script('text').items())} FROM {SCRIPT_INPUT}")
def script_counts(spark, d):
    return script_input(spark, d).select("id", *[c.cast("int").alias(f"n_{k}") for k, c in text.script_counts(F.col("text")).items()])


_S = s_script("text")
_TOP = f"greatest({_S['latin']}, {_S['hindi']}, {_S['kannada']})"


@query(
    f"SELECT id, CASE WHEN {_TOP} = 0 THEN CASE WHEN {_S['digits']} > 0 THEN 'latin' ELSE 'unknown' END WHEN {_S['latin']} = {_TOP} THEN 'latin' WHEN {_S['hindi']} = {_TOP} THEN 'hindi' ELSE 'kannada' END AS script FROM {SCRIPT_INPUT}"
)
def dominant_script(spark, d):
    return script_input(spark, d).select("id", text.dominant_script(F.col("text")).alias("script"))


_OWN = f"CASE language WHEN 'hindi' THEN {_S['hindi']} WHEN 'kannada' THEN {_S['kannada']} ELSE {_S['latin']} + {_S['digits']} END"
_ALL = "(" + " + ".join(_S.values()) + ")"
_PURITY = f"(CASE WHEN {_ALL} = 0 THEN 0.0 ELSE CAST({_OWN} AS DOUBLE) / {_ALL} END)"


@query(f"SELECT id, CAST({_OWN} AS INTEGER) AS n_own, round({_PURITY}, 6) AS purity FROM {SCRIPT_INPUT}")
def script_purity(spark, d):
    t, lang = F.col("text"), F.col("language")
    return script_input(spark, d).select("id", text.script_characters(t, lang).cast("int").alias("n_own"), F.round(text.script_purity(t, lang), 6).alias("purity"))


@query("SELECT doc_id, coalesce(nullif(lang, ''), nullif(text, ''), '') AS first_text FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END AS lang, text FROM documents)")
def text_coalesce(spark, d):
    lang = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, None).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", text.first_text(lang, F.col("text")).alias("first_text"))


# ------------------------------------------------------------------ OCR quality and selection

_T = s_strip("coalesce(text, '')")
_W = s_words(_T)
_USEFUL = rf"length(regexp_replace({_T}, '[^\p{{L}}\p{{N}}\s.,;:!?()\-/%₹$€£]', '', 'g'))"
_SHARE = f"(len(list_distinct({_W})) / CAST(len({_W}) AS DOUBLE))"


@query(
    f"""SELECT id, CASE WHEN length({_T}) = 0 THEN 0.0e0 ELSE round((confidence * 0.40e0 + {_USEFUL} / CAST(length({_T}) AS DOUBLE) * 0.20e0 + least(len({_W}) / 80.0e0, 1.0e0) * 0.15e0 + least(length({_T}) / 500.0e0, 1.0e0) * 0.25e0)
    * CASE WHEN length({_T}) < 20 THEN 0.10e0 WHEN length({_T}) < 50 THEN 0.45e0 WHEN length({_T}) < 100 THEN 0.75e0 ELSE 1.0e0 END
    * CASE WHEN len({_W}) < 10 THEN 1.0e0 WHEN {_SHARE} < 0.20e0 THEN 0.45e0 WHEN {_SHARE} < 0.35e0 THEN 0.70e0 ELSE 1.0e0 END + 1e-9, 4) END AS quality FROM {SCRIPT_INPUT}"""
)
def text_quality(spark, d):
    return ocr.score_pages(script_input(spark, d).withColumn("confidence", F.col("confidence") * 100)).select("id", "quality")


_LT = s_strip(r"regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')")
_BUCKET = f"CASE WHEN {_PURITY} < 0.20 THEN 0.0 WHEN {_PURITY} < 0.40 THEN 0.20 WHEN {_PURITY} < 0.60 THEN 0.50 WHEN {_PURITY} < 0.80 THEN 0.80 ELSE 1.0 END"
_LINE_QUALITY = f"CASE WHEN {_ALL} = 0 THEN 0.0 ELSE confidence * 0.40 + ({_ALL} - {_S['other']}) / CAST({_ALL} AS DOUBLE) * 0.30 + least(length({_LT}) / 40.0, 1.0) * 0.10 + ({_BUCKET}) * 0.20 END"
_VALID = f"({_T} <> '' AND coalesce(confidence, 0) >= 0.20 AND CASE WHEN language IN ('hindi', 'kannada') THEN ({_OWN}) >= 2 AND {_PURITY} >= 0.30 WHEN language = 'latin' THEN ({_OWN}) >= 1 AND {_PURITY} >= 0.20 ELSE true END)"


@query(f"SELECT id, round({_LINE_QUALITY}, 6) AS quality FROM {SCRIPT_INPUT}")
def line_quality(spark, d):
    return ocr.score_lines(script_input(spark, d)).select("id", F.round("quality", 6).alias("quality"))


@query(f"SELECT id, {_VALID} AS valid FROM {SCRIPT_INPUT}")
def valid_candidates(spark, d):
    return ocr.score_lines(script_input(spark, d)).select("id", "valid")


_GRID = "(SELECT unnest(['original', 'autocontrast', 'contrast', 'sharpen', 'threshold']) AS variant)"


@query(f"SELECT doc_id AS page, variant, psm FROM documents, {_GRID}, (SELECT unnest([3, 6, 11]) AS psm)")
def ocr_grid(spark, d):
    return ocr.ocr_grid(spark, table(spark, d, "documents").select(F.col("doc_id").alias("page"))).select("page", "variant", "psm")


_CANDIDATES = f"(SELECT * FROM {fx.CANDIDATES.sql(['key', 'ord', 'text', 'confidence', 'quality'])} UNION ALL SELECT * FROM {derived.CANDIDATES})"


@query(f"SELECT key, text, confidence, quality, ord FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(text) >= 50 DESC, quality DESC, ord) AS r FROM {_CANDIDATES} WHERE text <> '') WHERE r = 1")
def ocr_best(spark, d):
    return ocr.best_candidate(fx.CANDIDATES.spark(spark).unionByName(derived.candidates(spark, d)))


_GATE = "(SELECT doc_id AS page, text, CASE WHEN lang = 'en' THEN '' ELSE 'seen ' || lang END AS ocr_text FROM documents UNION ALL SELECT -id, text, 'seen ' || id FROM " + TEXTS + ")"
_USE = f"(length({_T}) < 40 AND coalesce(ocr_text, '') <> '')"


@query(f"SELECT page, {_USE} AS ocr_used, CASE WHEN {_USE} THEN ocr_text ELSE coalesce(text, '') END AS text FROM {_GATE}")
def ocr_gate(spark, d):
    docs = table(spark, d, "documents")
    seen = F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("seen "), "lang"))
    pages = docs.select(F.col("doc_id").alias("page"), "text", seen.alias("ocr_text"))
    short = fx.TEXTS.spark(spark).select((-F.col("id")).alias("page"), "text", F.concat(F.lit("seen "), F.col("id").cast("string")).alias("ocr_text"))
    return ocr.ocr_gate(pages.unionByName(short)).select("page", "ocr_used", "text")


_LINES = f"(SELECT * FROM {fx.LINES.sql(['line_id', 'ord', 'engine', 'language', 'text', 'confidence'])} UNION ALL SELECT * FROM {derived.LINES})"


def _lines(spark, d):
    return fx.LINES.spark(spark).unionByName(derived.lines(spark, d))


_LINE_BEST = f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY line_id) AS n, row_number() OVER (PARTITION BY line_id ORDER BY q DESC, ord) AS r FROM (SELECT *, {_LINE_QUALITY} AS q FROM {_LINES} WHERE {_VALID})) WHERE r = 1)"


@query(f"SELECT line_id, CASE WHEN q < 0.42 THEN 'uncertain' ELSE engine END AS engine, CASE WHEN q < 0.42 THEN '' ELSE text END AS text, confidence, round(q, 6) AS quality, n AS n_candidates FROM {_LINE_BEST}")
def line_select(spark, d):
    return ocr.select_lines(_lines(spark, d)).select("line_id", "engine", "text", "confidence", F.round("quality", 6).alias("quality"), "n_candidates")


@query(f"SELECT line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY ord) - 1 AS INTEGER) AS place, engine, language, text, confidence, round({_LINE_QUALITY}, 6) AS quality FROM {_LINES} WHERE {_VALID}")
def line_audit(spark, d):
    rows = ocr.select_lines(_lines(spark, d)).select("line_id", F.posexplode("candidates").alias("place", "c"))
    return rows.select("line_id", "place", *[F.col(f"c.{x}").alias(x) for x in ("engine", "language", "text", "confidence")], F.round("c.quality", 6).alias("quality"))


@query(
    f"""SELECT line_id // 100000 AS page, count(*) AS n_lines, count(*) FILTER (q >= 0.42) AS n_accepted, count(*) FILTER (q < 0.42) AS n_uncertain, count(*) FILTER (q >= 0.42 AND engine = 'tesseract') AS n_tesseract,
    round(coalesce(avg(confidence) FILTER (q >= 0.42), 0) + 1e-9, 6) AS mean_confidence, round(coalesce(avg(q) FILTER (q >= 0.42), 0) + 1e-9, 6) AS mean_quality FROM {_LINE_BEST} GROUP BY 1"""
)
def ocr_page_stats(spark, d):
    stats = ocr.page_stats(ocr.select_lines(_lines(spark, d)).withColumn("page", F.expr("line_id div 100000")))
    return stats.withColumn("mean_confidence", F.round(F.col("mean_confidence") + 1e-9, 6)).withColumn("mean_quality", F.round(F.col("mean_quality") + 1e-9, 6))


@query(
    f"""SELECT 'p' || line_id // 100000 || '.png' AS source, coalesce(string_agg(CASE WHEN q >= 0.42 THEN text END, chr(10) ORDER BY line_id) FILTER (q >= 0.42 AND text <> ''), '') AS text, count(*) AS ocr_line_count, count(*) FILTER (q >= 0.42) AS accepted_line_count,
    count(*) FILTER (q >= 0.42 AND engine = 'paddle') AS paddle_selected, count(*) FILTER (q >= 0.42 AND engine = 'tesseract') AS tesseract_selected, count(*) FILTER (q < 0.42) AS uncertain_line_count,
    array_to_string(list(CASE WHEN q < 0.42 THEN 'uncertain' ELSE engine END ORDER BY line_id), ',') AS engines FROM {_LINE_BEST} GROUP BY line_id // 100000"""
)
def ocr_page_results(spark, d):
    page = F.concat(F.lit("p"), F.expr("line_id div 100000").cast("string"), F.lit(".png"))
    rows = ocr.page_results(ocr.select_lines(_lines(spark, d)).withColumn("source", page))
    engines = F.array_join(F.transform("lines", lambda x: x["engine"]), ",").alias("engines")
    return rows.select("source", "text", "ocr_line_count", "accepted_line_count", "paddle_selected", "tesseract_selected", "uncertain_line_count", engines)


_BOXES = f"(SELECT page, CAST(i - 1 AS INTEGER) AS id, boxes[i].x1 AS x1, boxes[i].y1 AS y1, boxes[i].x2 AS x2, boxes[i].y2 AS y2 FROM (SELECT page, boxes, unnest(range(1, len(boxes) + 1)) AS i FROM (SELECT * FROM {fx.BOXES.sql(['page', 'boxes'])} UNION ALL SELECT * FROM {derived.BOXES})))"


_CLEAN_BOXES = f"(SELECT * FROM {_BOXES} WHERE x2 - x1 >= 8 AND y2 - y1 >= 5)"


def _boxes(spark, d):
    return fx.BOXES.spark(spark).unionByName(derived.boxes(spark, d))


@query(f"SELECT * FROM {_CLEAN_BOXES}")
def clean_boxes(spark, d):
    return ocr.clean_boxes(_boxes(spark, d))


@query(f"SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 0, 0, 90, 12, '0,1'), (1, 1, 5, 30, 70, 40, '3'), (1, 2, 400, 31, 450, 41, '4'), (2, 0, 1, 1, 9, 6, '0')) AS t(page, line, x1, y1, x2, y2, ids) UNION ALL {derived.line_boxes_sql(_CLEAN_BOXES)}")
def line_boxes(spark, d):
    return ocr.text_lines(ocr.clean_boxes(_boxes(spark, d)))


@query(f"SELECT CAST(1 AS BIGINT) AS key, 'Hello world' AS text, CAST(88.25 AS DOUBLE) AS confidence UNION ALL SELECT * FROM {derived.TSV_TEXT}")
def tsv_parse(spark, d):
    return ocr.parse_tsv(fx.TSV.spark(spark).unionByName(derived.tsv(spark, d)))


# ------------------------------------------------------------------ pages and chunks


@query(
    f"""SELECT source, page, {s_clean_ingest('text')} AS text, CAST(len(images) AS INTEGER) AS image_count, CAST(len(list_filter(tables, lambda t: len(t.rows) > 0)) AS INTEGER) AS table_count, {s_clean_ingest('text')} <> '' AS has_text,
    page_image IS NOT NULL OR len(images) > 0 OR len(list_filter(tables, lambda t: len(t.rows) > 0)) > 0 AS has_visual_content FROM (SELECT * FROM {ELEMENTS} UNION ALL BY NAME SELECT source, CAST(doc_id AS INTEGER) AS page, text, [] AS images, [] AS tables FROM documents)"""
)
def page_elements(spark, d):
    own = src.pages_from_documents(table(spark, d, "documents"))
    every = fx.ELEMENTS.spark(spark).withColumn("images", F.transform("images", lambda x: F.struct(F.lit(0).alias("image_index"), x["path"].alias("path"), x["width"].alias("width"), x["height"].alias("height"), x["extension"].alias("extension"))))
    every = every.withColumn("tables", F.transform("tables", lambda t: F.struct(F.lit(0).alias("table_index"), t["rows"].alias("rows")))).unionByName(own, allowMissingColumns=True)
    return src.page_elements(every).select("source", "page", "text", "image_count", "table_count", "has_text", "has_visual_content")


@query("SELECT doc_id, regexp_replace('My file (' || source || ').v2', '[^A-Za-z0-9_.\\-]', '_', 'g') || '_page_' || doc_id || '.png' AS page_file, regexp_replace('My file (' || source || ').v2', '[^A-Za-z0-9_.\\-]', '_', 'g') || '_page_' || doc_id || '_image_1.jpg' AS image_file FROM documents")
def image_names(spark, d):
    docs = table(spark, d, "documents")
    refs = docs.select("doc_id", F.concat(F.lit("My file ("), "source", F.lit(").v2.pdf")).alias("source"), F.col("doc_id").alias("page"), F.lit(1).alias("image_index"), F.lit("jpg").alias("extension"))
    return src.image_names(refs).select("doc_id", "page_file", "image_file")


@query(f"SELECT id FROM {ALL_TEXTS} WHERE {s_strip('coalesce(text, chr(32))')} <> ''")
def nonblank_pages(spark, d):
    return src.nonblank_pages(all_texts(spark, d)).select("id")


@query("SELECT source, string_agg(chr(10) || '--- Page ' || doc_id || ' ---' || chr(10) || coalesce(text, ''), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source")
def doc_concat(spark, d):
    return src.document_text(src.pages_from_documents(table(spark, d, "documents")))


@query(
    f"SELECT id, chunk, text FROM (SELECT id, CAST(a / 800 AS INTEGER) AS chunk, {s_strip('substring(text, a + 1, 1000)')} AS text FROM (SELECT id, text, CAST(unnest(range(0, length(text), 800)) AS BIGINT) AS a FROM {ALL_TEXTS} WHERE length(text) > 0)) WHERE text <> ''".replace("a / 800", "a // 800")
)
def fixed_chunks(spark, d):
    return chunking.fixed_chunks(all_texts(spark, d)).select("id", "chunk", "text")


def _chunk_sql(merge: bool) -> str:
    return f"SELECT id, CAST(i - 1 AS INTEGER) AS chunk, p[i].text AS text, CAST(p[i].n AS INTEGER) AS n_words FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT id, {s_packs('s', merge)} AS p FROM (SELECT id, {s_sentences('text')} AS s FROM {ALL_TEXTS}) WHERE len(s) > 0))"


@query(_chunk_sql(False))
def sentence_chunks(spark, d):
    return chunking.sentence_chunks(all_texts(spark, d), merge=False).select("id", "chunk", "text", "n_words")


@query(_chunk_sql(True))
def merged_chunks(spark, d):
    return chunking.sentence_chunks(all_texts(spark, d)).select("id", "chunk", "text", "n_words")


def s_table(rows: str) -> str:
    cells = f"array_to_string(list_transform({rows}[i], lambda c: {s_clean_chunk('c')}), ' | ')"
    return f"array_to_string(list_filter(list_transform(range(1, len({rows}) + 1), lambda i: CASE WHEN len({rows}[i]) > 0 AND {s_strip(cells)} <> '' THEN 'Row ' || i || ': ' || {cells} END), lambda x: x IS NOT NULL), chr(10))"


def s_tables(tables: str) -> str:
    one = s_table(f"{tables}[k].rows")
    return f"array_to_string(list_filter(list_transform(range(1, len({tables}) + 1), lambda k: CASE WHEN {s_strip(one)} <> '' THEN 'TABLE ' || k || chr(10) || {one} END), lambda x: x IS NOT NULL), chr(10) || chr(10))"


def s_images(images: str) -> str:
    size = f"CASE WHEN {images}[k].width <> 0 AND {images}[k].height <> 0 THEN ', dimensions ' || {images}[k].width || 'x' || {images}[k].height ELSE '' END"
    return f"array_to_string(list_transform(range(1, len({images}) + 1), lambda k: 'Embedded image ' || k || ' (' || coalesce({images}[k].extension, 'unknown') || ')' || {size}), chr(10))"


_LAID_OUT = f"(SELECT * FROM {ELEMENTS} UNION ALL SELECT * EXCLUDE (chunk_id) FROM {derived.ELEMENTS})"


def _laid_out(spark, d):
    return fx.ELEMENTS.spark(spark).unionByName(derived.elements(spark, d).drop("chunk_id"))


@query(f"SELECT source, page, {s_tables('tables')} AS text FROM {_LAID_OUT}")
def table_text(spark, d):
    return _laid_out(spark, d).select("source", "page", chunking.tables_text(F.col("tables")).alias("text"))


@query(f"SELECT source, page, {s_images('images')} AS text FROM {_LAID_OUT}")
def image_text(spark, d):
    return _laid_out(spark, d).select("source", "page", chunking.images_text(F.col("images")).alias("text"))


_LOOSE = fx.LOOSE_PAGES.sql(["source", "page", "text", "ocr_used", "ocr_languages", "ocr_confidence"])
_NO_LAYOUT = "[] AS images, [] AS tables, false AS has_visual_content"
_PAGE_INPUT = f"""(SELECT * REPLACE (coalesce(source, 'Unknown') AS source, coalesce(page, 0) AS page, coalesce(ocr_used, false) AS ocr_used) FROM (SELECT * FROM {ELEMENTS}
    UNION ALL BY NAME SELECT source, CAST(doc_id AS INTEGER) AS page, text, false AS ocr_used, {_NO_LAYOUT} FROM documents
    UNION ALL BY NAME SELECT *, {_NO_LAYOUT} FROM {_LOOSE}))"""
_PAGE_FIELDS = "CASE WHEN ocr_used THEN ocr_languages END AS ocr_languages, coalesce(ocr_confidence, 0) AS ocr_confidence, coalesce(ocr_quality, 0) AS ocr_quality, CAST(len(images) AS INTEGER) AS image_count, CAST(len(tables) AS INTEGER) AS table_count"
PAGE_CHUNKS = f"""(WITH p AS (SELECT *, {s_clean_chunk('text')} AS t, {s_sentences('text')} AS s FROM {_PAGE_INPUT}), items AS (
    SELECT source, page, ocr_used, {_PAGE_FIELDS}, i AS seq, 'text' AS content_type, 'body' AS region, k[i].text AS text, has_visual_content FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM (SELECT *, {s_packs('s')} AS k FROM p WHERE len(s) > 0))
    UNION ALL SELECT source, page, ocr_used, {_PAGE_FIELDS}, 1000001, 'table', 'table', {s_tables('tables')}, true FROM p WHERE {s_tables('tables')} <> ''
    UNION ALL SELECT source, page, ocr_used, {_PAGE_FIELDS}, 1000002, 'image', 'image', 'Visual content on page ' || page || '.' || chr(10) || {s_images('images')}, true FROM p WHERE {s_images('images')} <> ''
    UNION ALL SELECT source, page, ocr_used, {_PAGE_FIELDS}, 1000003, 'visual_page', 'visual_page', 'Visual page ' || page || ' from ' || source || '. Rendered page image available.', true FROM p WHERE page_image IS NOT NULL AND t = '')
    SELECT row_number() OVER (ORDER BY source, page, seq) - 1 AS chunk_id, * EXCLUDE (seq) FROM items)"""


def _page_chunks(spark, d):
    own = src.pages_from_documents(table(spark, d, "documents")).withColumn("ocr_used", F.lit(False)).withColumn("has_visual_content", F.lit(False)).withColumn("images", F.array().cast("array<struct<path:string,width:int,height:int,extension:string>>")).withColumn("tables", F.array().cast("array<struct<rows:array<array<string>>>>"))
    pages = fx.ELEMENTS.spark(spark).unionByName(own, allowMissingColumns=True).unionByName(fx.LOOSE_PAGES.spark(spark), allowMissingColumns=True)
    return chunking.page_chunks(pages)


@query(f"SELECT *, 'Unknown' AS section, 'Unknown' AS subsection FROM {PAGE_CHUNKS}")
def page_chunks(spark, d):
    return _page_chunks(spark, d).drop("page_image", "images", "tables")


_BLOCKS = f"(SELECT * FROM {fx.BLOCKS.sql(['source', 'page', 'region', 'section', 'subsection', 'text'])} UNION ALL SELECT * FROM {derived.BLOCKS})"


@query(
    f"""SELECT source, page, region, section, subsection, CAST(i - 1 AS INTEGER) AS chunk, p[i] AS text, 'text' AS content_type, false AS ocr_used, false AS has_visual_content FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (
    SELECT source, coalesce(page, 0) AS page, coalesce(region, 'body') AS region, coalesce(section, 'Unknown') AS section, coalesce(subsection, 'Unknown') AS subsection, CASE WHEN region = 'header' THEN [{s_clean_chunk('text')}] ELSE list_transform({s_packs('s')}, lambda q: q.text) END AS p
    FROM (SELECT *, {s_sentences('text')} AS s FROM {_BLOCKS}) WHERE {s_clean_chunk('text')} <> ''))"""
)
def legacy_chunks(spark, d):
    return chunking.legacy_chunks(fx.BLOCKS.spark(spark).unionByName(derived.blocks(spark, d)))


def _stats_sql(by: str, value: str) -> str:
    return f"SELECT '{by}' AS by, CAST({value} AS VARCHAR) AS value, count(*) AS n, count(*) FILTER (ocr_used) AS n_ocr, count(*) FILTER (has_visual_content) AS n_visual, count(*) FILTER (content_type = 'table') AS n_table, count(*) FILTER (content_type = 'image') AS n_image FROM c GROUP BY {value}"


@query(f"WITH c AS (SELECT *, 'all' AS everything FROM {PAGE_CHUNKS}) " + " UNION ALL ".join(_stats_sql(b, v) for b, v in (("region", "region"), ("content_type", "content_type"), ("source", "source"), ("all", "everything"))))
def chunk_stats(spark, d):
    return chunking.chunk_stats(_page_chunks(spark, d))


@query(f"SELECT chunk_id FROM {PAGE_CHUNKS} WHERE content_type IN ('text', 'table') AND {s_strip('text')} <> ''")
def embeddable(spark, d):
    return embedding.embeddable(_page_chunks(spark, d)).select("chunk_id")


@query(f"SELECT content_type, count(*) AS n, count(*) FILTER (content_type IN ('text', 'table')) AS n_embedded FROM {PAGE_CHUNKS} GROUP BY 1")
def embed_stats(spark, d):
    return embedding.embed_stats(_page_chunks(spark, d))


@query(f"SELECT source, count(DISTINCT page) AS n_pages FROM {PAGE_CHUNKS} WHERE content_type = 'table' GROUP BY source")
def table_pages(spark, d):
    return visual.table_pages(_page_chunks(spark, d)).groupBy("source").agg(F.count_distinct("page").alias("n_pages"))


@query(
    f"""SELECT count(DISTINCT source) AS n_documents, count(*) AS n_pages, count(*) FILTER (ocr_used) AS n_ocr, CAST(sum(len(images)) AS BIGINT) AS n_images, CAST(sum(len(list_filter(tables, lambda t: len(t.rows) > 0))) AS BIGINT) AS n_tables, count(page_image) AS n_rendered,
    round(coalesce(avg(ocr_confidence) FILTER (ocr_used AND ocr_confidence > 0), 0), 6) AS mean_confidence, round(coalesce(avg(ocr_quality) FILTER (ocr_used AND ocr_quality > 0), 0), 6) AS mean_quality FROM {_LAID_OUT}"""
)
def ingest_summary(spark, d):
    rows = _laid_out(spark, d).withColumn("image_count", F.size("images")).withColumn("table_count", F.size(F.filter("tables", lambda t: F.size(t["rows"]) > 0)))
    return evaluation.ingest_summary(rows).withColumn("mean_confidence", F.round("mean_confidence", 6)).withColumn("mean_quality", F.round("mean_quality", 6))


# ------------------------------------------------------------------ vectors and ranking


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _queries(spark, d):
    return table(spark, d, "benchmark").join(_vectors(spark, d), F.col("item_id") == F.col("chunk_id")).select(F.col("item_id").alias("q_id"), F.col("text").alias("question"), "vector")


def _doc_chunks(spark, d, dealt: bool = True):
    """Documents as chunks; regions are dealt by id, since the table has none.

    Where texts are only looked up, small tables need not be dealt to all cores.
    """
    region = F.element_at(F.array(*map(F.lit, ("body", "abstract", "header", "table"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, d, "documents") if dealt else spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("chunk_id"), "source", F.col("doc_id").cast("int").alias("page"), region.alias("region"), F.lit("Unknown").alias("section"), F.lit("Unknown").alias("subsection"), F.lit("text").alias("content_type"), "text")


_INDEXES: dict[tuple, InvertedIndex | VectorIndex] = {}


def _index(spark, d):
    """The stored postings of the documents of ``d``: written by the first query of an application that needs them."""
    key = (spark.sparkContext.applicationId, d, *sorted(_doc_chunks(spark, d, dealt=False).inputFiles()))
    if key not in _INDEXES:
        _INDEXES[key] = InvertedIndex.build(_doc_chunks(spark, d), new_folder(spark, "documents-index"))
    return _INDEXES[key]


def _vector_index(spark, d):
    """The stored index of the vectors of ``d``, as above."""
    key = (spark.sparkContext.applicationId, d, *sorted(_vectors(spark, d).inputFiles()))
    if key not in _INDEXES:
        _INDEXES[key] = VectorIndex.build(_vectors(spark, d), new_folder(spark, "vectors-index"))
    return _INDEXES[key]


DOC_CHUNKS = "(SELECT doc_id AS chunk_id, source, CAST(doc_id AS INTEGER) AS page, (['body', 'abstract', 'header', 'table'])[doc_id % 4 + 1] AS region, 'text' AS content_type, text FROM documents)"
_DOT = "list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
DENSE = f"(SELECT q.vec_id AS q_id, v.vec_id AS chunk_id, {_DOT} AS score FROM embeddings v, embeddings q SEMI JOIN benchmark b ON b.item_id = q.vec_id)"
_TOP5 = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM {DENSE}) WHERE rank <= 5)"


@query(f"SELECT q_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM {_TOP5}")
def knn_top5(spark, d):
    return retrieval.similarities(_vectors(spark, d), _queries(spark, d), k=5, index=_vector_index(spark, d)).select("q_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT q_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score, source FROM {_TOP5} JOIN {DOC_CHUNKS} USING (chunk_id) WHERE score >= 0.15")
def dense_retrieve(spark, d):
    return retrieval.dense_retrieve(_doc_chunks(spark, d), _vectors(spark, d), _queries(spark, d), index=_vector_index(spark, d)).select("q_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "source")


_ASKED = "(SELECT item_id AS q_id, text AS question FROM benchmark SEMI JOIN embeddings ON item_id = vec_id)"
SCATTER = f"(SELECT a.q_id, c.doc_id AS chunk_id, coalesce(s.score, 0.0) AS semantic FROM documents c CROSS JOIN {_ASKED} a LEFT JOIN {DENSE} s ON s.q_id = a.q_id AND s.chunk_id = c.doc_id)"


@query(f"SELECT q_id, chunk_id, round(semantic, 6) AS semantic FROM {SCATTER}")
def semantic_scatter(spark, d):
    return retrieval.semantic_scores(_doc_chunks(spark, d), _vectors(spark, d), _queries(spark, d)).withColumn("semantic", F.round("semantic", 6))


def s_bm25(questions: str) -> str:
    return f"""(WITH t AS (SELECT doc_id, unnest({s_tokens('text')}) AS term FROM documents), len AS (SELECT doc_id, len({s_tokens('text')}) AS len FROM documents), corpus AS (SELECT count(*) AS n, avg(len) AS avglen FROM len),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, corpus),
        idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw), asked AS (SELECT q_id, term, count(*) AS times FROM (SELECT q_id, unnest({s_tokens('question')}) AS term FROM {questions}) GROUP BY ALL)
        SELECT q_id, doc_id AS chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avglen))) AS bm25 FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (doc_id), corpus GROUP BY ALL)"""


@query(f"SELECT q_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(bm25, 6) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(bm25, 6) DESC, chunk_id) AS rank FROM {s_bm25('(SELECT item_id AS q_id, text AS question FROM benchmark)')}) WHERE rank <= 10")
def bm25_top10(spark, d):
    return retrieval.bm25_top(_doc_chunks(spark, d, dealt=False), _asked(spark, d), k=10, index=_index(spark, d))


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


_DF = f"(SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({s_tokens('text')}) AS term FROM documents) GROUP BY term)"
_RAW = f"(SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM {_DF}, (SELECT count(*) AS n FROM documents))"


@query(f"WITH r AS (SELECT * FROM {_RAW}) SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END, 6) AS idf FROM r")
def term_weights(spark, d):
    return _index(spark, d).terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    f"""WITH t AS (SELECT doc_id, unnest({s_tokens('text')}) AS term FROM documents), len AS (SELECT doc_id, len({s_tokens('text')}) AS len FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
    SELECT term, doc_id // 4096 AS range, count(*) AS n, round(max(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM len)))), 6) AS most FROM tf JOIN len USING (doc_id) GROUP BY ALL"""
)
def posting_blocks(spark, d):
    return _index(spark, d).blocks().select("term", "range", "n", F.round("most", 6).alias("most"))


def s_keyword(questions: str) -> str:
    return f"(SELECT q_id, doc_id AS chunk_id, len(list_intersect(qt, dt)) / CAST(len(qt) AS DOUBLE) AS keyword FROM (SELECT q_id, list_distinct({s_tokens('question')}) AS qt FROM {questions}), (SELECT doc_id, list_distinct({s_tokens('text')}) AS dt FROM documents) WHERE len(list_intersect(qt, dt)) > 0)"


@query(f"SELECT q_id, chunk_id, round(keyword, 6) AS keyword FROM {s_keyword('(SELECT item_id AS q_id, text AS question FROM benchmark)')}")
def keyword_overlap(spark, d):
    return retrieval.keyword_overlap(_doc_chunks(spark, d, dealt=False), _asked(spark, d), _index(spark, d)).withColumn("keyword", F.round("keyword", 6))


@query("SELECT doc_id, source, round(CASE WHEN max(n_chars) OVER w - min(n_chars) OVER w < 1e-8 THEN 0.0 ELSE (n_chars - min(n_chars) OVER w) / CAST(max(n_chars) OVER w - min(n_chars) OVER w AS DOUBLE) END, 6) AS score FROM documents WINDOW w AS (PARTITION BY source)")
def minmax_norm(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score"))
    return retrieval.minmax(docs, "score", by="source").select("doc_id", "source", F.round("score", 6).alias("score"))


def s_intent(q: str, more: tuple[str, ...] = fx.DOMAIN_PACK.technical) -> str:
    out = "CASE"
    for name, region, phrases in lex.INTENTS:
        out += f" WHEN {s_any(f'lower({q})', phrases + (more if name == 'technical' else ()))} THEN '{region}'"
    return f"{out} ELSE 'general' END"


def s_objective(q: str) -> str:
    return s_any(f"lower({q})", lex.OBJECTIVE_QUERY)


def s_expand(q: str) -> str:
    out = f"coalesce({q}, '')"
    for triggers, phrase in fx.DOMAIN_PACK.expansions:
        out += f" || CASE WHEN {s_objective(q) if triggers is None else s_any(f'lower({q})', triggers)} THEN {fx.literal(phrase)} ELSE '' END"
    return f"({out})"


def s_region(region: str, intent: str) -> str:
    return "CASE " + " ".join(f"WHEN {intent} = '{i}' AND {region} = '{r}' THEN {v}" for (i, r), v in lex.REGION_ADJUSTMENT.items()) + " ELSE 0.0 END"


def s_objective_score(q: str, t: str) -> str:
    terms = fx.literal([*lex.OBJECTIVE_TERMS, *fx.DOMAIN_PACK.objective_terms])
    triple = " AND ".join(f"contains(lower({t}), '{x}')" for x in lex.OBJECTIVE_TRIPLE)
    return f"CASE WHEN {s_objective(q)} THEN len(list_filter({terms}, lambda p: contains(lower({t}), p))) * 0.05 + CASE WHEN {s_any(f'lower({t})', lex.OBJECTIVE_PHRASES)} THEN 0.25 ELSE 0.0 END + CASE WHEN {triple} THEN 0.20 ELSE 0.0 END ELSE 0.0 END"


_HYBRID_Q = f"(SELECT q_id, {s_expand('question')} AS question FROM {_ASKED})"
_SCALED = ", ".join(f"CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-8 THEN 0.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {c}_score" for c in ("semantic", "bm25", "keyword"))
HYBRID = f"""(WITH raw AS (SELECT s.q_id, s.chunk_id, semantic, coalesce(b.bm25, 0) AS bm25, coalesce(k.keyword, 0) AS keyword FROM {SCATTER} s LEFT JOIN {s_bm25(_HYBRID_Q)} b USING (q_id, chunk_id) LEFT JOIN {s_keyword(_HYBRID_Q)} k USING (q_id, chunk_id)),
    scaled AS (SELECT *, {_SCALED} FROM raw WINDOW w AS (PARTITION BY q_id)), scored AS (SELECT *, 0.55 * semantic_score + 0.30 * bm25_score + 0.15 * keyword_score AS hybrid_score FROM scaled),
    adjusted AS (SELECT s.*, c.source, c.page, c.region, c.content_type, c.text, {s_intent('a.question')} AS intent, {s_objective_score('a.question', 'c.text')} AS objective_score FROM scored s JOIN {_ASKED} a USING (q_id) JOIN {DOC_CHUNKS} c USING (chunk_id)),
    final AS (SELECT * REPLACE (CAST(objective_score AS DOUBLE) AS objective_score), CAST({s_region('region', 'intent')} AS DOUBLE) AS region_adjustment FROM adjusted)
    SELECT * FROM (SELECT *, hybrid_score + region_adjustment + objective_score AS final_score, row_number() OVER (PARTITION BY q_id ORDER BY round(hybrid_score + region_adjustment + objective_score, 9) DESC, chunk_id DESC) AS rank FROM final) WHERE rank <= 5)"""
_SCORES = ("semantic_score", "bm25_score", "keyword_score", "hybrid_score", "region_adjustment", "objective_score", "final_score")


def _hybrid(spark, d):
    return retrieval.hybrid_search(_doc_chunks(spark, d), _vectors(spark, d), _queries(spark, d), k=5, index=_index(spark, d))


@query(f"SELECT q_id, CAST(rank AS INTEGER) AS rank, chunk_id, intent, {', '.join(f'round({c}, 6) AS {c}' for c in _SCORES)} FROM {HYBRID}")
def hybrid_search(spark, d):
    return _hybrid(spark, d).select("q_id", "rank", "chunk_id", "intent", *[F.round(c, 6).alias(c) for c in _SCORES])


@query("SELECT round(avg(n), 6) AS mean_norm, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, count(*) AS n_vectors FROM (SELECT sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)")
def norm_stats(spark, d):
    return embedding.norm_stats(_vectors(spark, d)).select("n_vectors", *[F.round(c, 6).alias(c) for c in ("mean_norm", "min_norm", "max_norm")])


@query(f"SELECT chunk_id, source, page, region, label, text FROM embeddings JOIN {DOC_CHUNKS} ON vec_id = chunk_id")
def vector_store(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return embedding.vector_store(_doc_chunks(spark, d), vectors).select("chunk_id", "source", "page", "region", "label", "text")


@query(f"WITH s AS (SELECT * FROM embeddings JOIN {DOC_CHUNKS} ON vec_id = chunk_id) SELECT 'content_type' AS by, content_type AS value, count(*) AS n, CAST(0 AS BIGINT) AS n_ocr FROM s GROUP BY content_type UNION ALL SELECT 'source', source, count(*), 0 FROM s GROUP BY source")
def vector_stats(spark, d):
    store = embedding.vector_store(_doc_chunks(spark, d).withColumn("ocr_used", F.lit(False)), _vectors(spark, d))
    return embedding.vector_stats(store)


@query(
    """SELECT 'vector_without_chunk' AS check, 'error' AS severity, count(*) AS violations FROM embeddings ANTI JOIN documents ON vec_id = doc_id
    UNION ALL SELECT 'chunk_without_vector', 'warn', count(*) FROM (SELECT * FROM documents WHERE trim(text) <> '') ANTI JOIN embeddings ON vec_id = doc_id
    UNION ALL SELECT 'duplicate_vector_id', 'error', count(*) FROM (SELECT vec_id FROM embeddings GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate_chunk_key', 'error', count(*) FROM (SELECT doc_id FROM documents GROUP BY source, doc_id HAVING count(*) > 1)
    UNION ALL SELECT 'wrong_dimension', 'error', count(*) FROM embeddings WHERE len(embedding) <> 64
    UNION ALL SELECT 'not_unit_norm', 'warn', count(*) FROM embeddings WHERE abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-3"""
)
def integrity_report(spark, d):
    return embedding.integrity_report(_doc_chunks(spark, d), _vectors(spark, d), dims=64)


# ------------------------------------------------------------------ routing


@query(f"SELECT q_id, {s_intent('question')} AS intent FROM {ALL_QUESTIONS}")
def query_intent(spark, d):
    return all_questions(spark, d).select("q_id", routing.intent(F.col("question"), fx.DOMAIN_PACK).alias("intent"))


_FLAGS = {"objective": lex.OBJECTIVE_QUERY, "tabular": lex.TABLE_WORDS, "visual": lex.VISUAL_WORDS, "fusion": lex.FUSION_WORDS, "comparison": lex.COMPARISON_PHRASES}


@query(f"SELECT q_id, {', '.join(f'{s_any('lower(question)', v)} AS {k}' for k, v in _FLAGS.items())} FROM {ALL_QUESTIONS}")
def query_flags(spark, d):
    q = F.col("question")
    return all_questions(spark, d).select("q_id", routing.is_objective(q).alias("objective"), routing.is_table(q).alias("tabular"), routing.is_visual(q).alias("visual"), routing.is_fusion(q).alias("fusion"), routing.is_comparison(q).alias("comparison"))


_TAGGED = " || ".join(f"CASE WHEN {s_any('lower(text)', v)} THEN '{k},' ELSE '' END" for k, v in sorted(_FLAGS.items()))


@query(f"SELECT id, rtrim({_TAGGED}, ',') AS tags FROM (SELECT id, coalesce(text, '') AS text FROM (SELECT id, text FROM {ALL_TEXTS} UNION ALL SELECT 10000000 + q_id, question FROM {ALL_QUESTIONS}))")
def phrase_tags(spark, d):
    """The lists of the flags as one lexicon table, over whole documents and all questions."""
    lexicon = spark.createDataFrame([(p, tag) for tag, found in _FLAGS.items() for p in found], "phrase string, tag string")
    asked = all_questions(spark, d).select((F.col("q_id") + 10_000_000).alias("id"), F.col("question").alias("text"))
    rows = phrases.with_tags(all_texts(spark, d).unionByName(asked), F.col("text"), lexicon)
    return rows.select("id", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT q_id, {s_expand('question')} AS expanded FROM {ALL_QUESTIONS}")
def query_expand(spark, d):
    return all_questions(spark, d).select("q_id", routing.expand(F.col("question"), fx.DOMAIN_PACK).alias("expanded"))


def s_route(q: str) -> str:
    kinds = (("comparison", lex.COMPARISON_PHRASES), ("fusion", lex.FUSION_WORDS), ("table", lex.TABLE_WORDS), ("visual", lex.VISUAL_WORDS))
    return "CASE " + " ".join(f"WHEN {s_any(f'lower({q})', phrases)} THEN '{route}'" for route, phrases in kinds) + " ELSE 'text' END"


@query(f"SELECT q_id, {s_route('question')} AS route FROM {ALL_QUESTIONS}")
def route_questions(spark, d):
    return all_questions(spark, d).select("q_id", routing.route(F.col("question")).alias("route"))


def s_first(q: str, *patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({q}, '{p}', 1), '')" for p in patterns) + ")"


@query(rf"SELECT q_id, TRY_CAST({s_first('question', r'(?i)\bpage\s*(\d+)\b', r'(?i)\bp\.\s*(\d+)\b', r'(?i)\bpg\.?\s*(\d+)\b')} AS INTEGER) AS page FROM {ALL_QUESTIONS}")
def page_refs(spark, d):
    return all_questions(spark, d).select("q_id", routing.requested_page(F.col("question")).alias("page"))


@query(rf"SELECT q_id, upper({s_first('question', r'(?i)\btable\s*([IVXLCDM]+)\b', r'(?i)\btable\s*(\d+)\b')}) AS number FROM {ALL_QUESTIONS}")
def table_refs(spark, d):
    return all_questions(spark, d).select("q_id", routing.table_number(F.col("question")).alias("number"))


_PAIRED = f"""(SELECT doc_id, item_id AS q_id, region, {s_intent('b.text')} AS intent FROM (SELECT chunk_id AS doc_id, region FROM {DOC_CHUNKS}) c JOIN benchmark b ON c.doc_id % 40 = b.item_id % 40
    UNION ALL SELECT -1, -1, region, intent FROM (SELECT unnest(['header', 'abstract', 'body', 'table']) AS region), (SELECT unnest(['header', 'abstract', 'body', 'general']) AS intent))"""


@query(f"SELECT *, CAST({s_region('region', 'intent')} AS DOUBLE) AS adjustment FROM {_PAIRED}")
def region_adjust(spark, d):
    """Chunks with the questions dealt to them, and every region with every intent."""
    asked = _asked(spark, d).select("q_id", routing.intent(F.col("question"), fx.DOMAIN_PACK).alias("intent"))
    met = _doc_chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), "region").join(asked, F.col("doc_id") % 40 == F.col("q_id") % 40)
    every = spark.createDataFrame([(-1, -1, r, i) for r in ("header", "abstract", "body", "table") for i in ("header", "abstract", "body", "general")], "doc_id long, q_id long, region string, intent string")
    return met.unionByName(every).withColumn("adjustment", routing.region_adjustment(F.col("region"), F.col("intent")))


_OBJECTIVE_TEXT = "(SELECT id, CASE WHEN id % 2 = 0 THEN 'This paper proposes an integrated framework to monitor and predict; it aims to ' ELSE '' END || coalesce(text, '') AS text FROM " + ALL_TEXTS + ")"


@query(f"SELECT id, round(CAST({s_objective_score(fx.literal('What is the purpose?'), 'text')} AS DOUBLE), 6) AS score FROM {_OBJECTIVE_TEXT}")
def objective_score(spark, d):
    lead = F.when(F.col("id") % 2 == 0, "This paper proposes an integrated framework to monitor and predict; it aims to ").otherwise("")
    rows = all_texts(spark, d).withColumn("text", F.concat(lead, F.coalesce("text", F.lit(""))))
    return rows.select("id", F.round(routing.objective_score(F.lit("What is the purpose?"), F.col("text")), 6).alias("score"))


# ------------------------------------------------------------------ visual evidence


def _visual_chunks(spark, d):
    rows = fx.ELEMENTS.spark(spark).withColumn("chunk_id", F.row_number().over(_by("source", "page")).cast("long")).unionByName(derived.elements(spark, d))
    return rows.withColumn("content_type", F.when(F.size("images") > 0, "image").when(F.size("tables") > 0, "table").otherwise("visual_page"))


def _by(*columns: str):
    from pyspark.sql.window import Window

    return Window.orderBy(*columns)  # a literal table of four rows


VISUAL = f"(SELECT *, CASE WHEN len(images) > 0 THEN 'image' WHEN len(tables) > 0 THEN 'table' ELSE 'visual_page' END AS content_type FROM (SELECT *, row_number() OVER (ORDER BY source, page) AS chunk_id FROM {ELEMENTS} UNION ALL SELECT * FROM {derived.ELEMENTS}))"
_AVAILABLE = f"(SELECT source, page, chunk_id, coalesce(list_filter(images, lambda x: coalesce(x.path, '') <> '')[1].path, nullif(page_image.path, '')) AS path FROM {VISUAL} WHERE coalesce(list_filter(images, lambda x: coalesce(x.path, '') <> '')[1].path, nullif(page_image.path, '')) IS NOT NULL)"


@query(f"SELECT source, page, chunk_id, im.path AS path FROM (SELECT source, page, chunk_id, unnest(images) AS im FROM {VISUAL} WHERE content_type = 'image') WHERE coalesce(im.path, '') <> ''")
def image_chunks(spark, d):
    return visual.image_chunks(_visual_chunks(spark, d))


@query(f"SELECT source, page, chunk_id, path FROM {_AVAILABLE}")
def available_pages(spark, d):
    return visual.available_pages(_visual_chunks(spark, d))


_PAGE_REF = rf"TRY_CAST({s_first('question', r'(?i)\bpage\s*(\d+)\b', r'(?i)\bp\.\s*(\d+)\b', r'(?i)\bpg\.?\s*(\d+)\b')} AS INTEGER)"
_TABLE_REF = rf"upper({s_first('question', r'(?i)\btable\s*([IVXLCDM]+)\b', r'(?i)\btable\s*(\d+)\b')})"
_FOUND_PAGES = [(13, 1, "a.pdf", 2), (13, 2, "a.pdf", 3), (1, 1, "a.pdf", 2), (7, 1, "b c.pdf", 1), (9, 1, "a.pdf", 1), (9, 2, "none.pdf", 1), (17, 1, "a.pdf", 3)]


@query(
    f"""WITH have AS (SELECT source, page, path FROM {_AVAILABLE}), found AS (SELECT * FROM (VALUES {', '.join(map(str, _FOUND_PAGES))}) AS t(q_id, rank, source, page) UNION ALL SELECT * FROM {derived.PAGES_FOUND}),
    tabled AS (SELECT source, page, path, n FROM (SELECT *, row_number() OVER (ORDER BY page, source) AS n FROM (SELECT DISTINCT source, page FROM {VISUAL} WHERE content_type = 'table' AND page IS NOT NULL)) JOIN have USING (source, page) WHERE n <= {visual.MOST_PAGES}),
    shown AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY page, source) AS n FROM have) WHERE n <= {visual.MOST_PAGES}),
    q AS (SELECT q_id, {_PAGE_REF} AS asked, {_TABLE_REF} AS numbered, {s_any('lower(question)', lex.TABLE_WORDS)} AS tabular, {s_any('lower(question)', lex.VISUAL_WORDS)} AS looking FROM (SELECT * FROM {QUESTIONS} UNION ALL SELECT 1000 + item_id, text FROM benchmark)),
    every AS (SELECT q_id, 0 AS level, 1 AS n, source, page, path FROM (SELECT q_id, have.*, row_number() OVER (PARTITION BY q_id ORDER BY source) AS r FROM q JOIN have ON asked = page) WHERE r = 1
        UNION ALL SELECT q_id, 1, n, source, page, path FROM q, tabled WHERE numbered IS NOT NULL
        UNION ALL SELECT q_id, 2, rank, source, page, path FROM found JOIN have USING (source, page)
        UNION ALL SELECT q_id, 3, n, source, page, path FROM q, tabled WHERE tabular AND n = 1
        UNION ALL SELECT q_id, 4, n, source, page, path FROM q, shown WHERE looking),
    kept AS (SELECT *, row_number() OVER (PARTITION BY q_id, source, page ORDER BY level, n) AS again FROM (SELECT *, min(level) OVER (PARTITION BY q_id) AS lowest FROM every) WHERE level = lowest OR lowest = 1 AND level = 2)
    SELECT CAST(q_id AS BIGINT) AS q_id, CAST(place AS INTEGER) AS place, source, CAST(page AS INTEGER) AS page, path FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY level, n, source) AS place FROM kept WHERE again = 1) WHERE place <= CASE WHEN level = 0 THEN 1 ELSE {visual.MOST_PAGES} END"""
)
def visual_select(spark, d):
    chunks = _visual_chunks(spark, d)
    results = spark.createDataFrame(_FOUND_PAGES, "q_id long, rank int, source string, page int").unionByName(derived.pages_found(spark, d))
    asked = fx.QUESTIONS.spark(spark).unionByName(_asked(spark, d).withColumn("q_id", F.col("q_id") + 1_000))
    return visual.select_pages(asked, results, visual.available_pages(chunks), visual.table_pages(chunks))


@query(f"SELECT id, CAST(greatest(1, floor(width * s)) AS INTEGER) AS new_width, CAST(greatest(1, floor(height * s)) AS INTEGER) AS new_height FROM (SELECT *, least(850 / CAST(width AS DOUBLE), 1100 / CAST(height AS DOUBLE), 1.0) AS s FROM (SELECT * FROM {fx.SIZES.sql(['id', 'width', 'height'])} UNION ALL SELECT * FROM {derived.SIZES}))")
def resize_dims(spark, d):
    return visual.resize_dims(fx.SIZES.spark(spark).unionByName(derived.sizes(spark, d))).select("id", "new_width", "new_height")


# ------------------------------------------------------------------ memory

TURNS = "(SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant' AND answer <> '')"
_WINDOW = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM {TURNS}) WHERE age <= 4)"
_MEMORY = f"(SELECT conv_id, left(string_agg('User: ' || question || chr(10) || 'Assistant: ' || left(answer, 1000), chr(10) || chr(10) ORDER BY turn), 3500) AS memory FROM {_WINDOW} GROUP BY conv_id)"


def _turns(spark, d):
    return memory.answered_turns(table(spark, d, "conversations"))


@query(f"SELECT conv_id, turn, CAST(age AS INTEGER) AS age, question, answer FROM {_WINDOW}")
def memory_window(spark, d):
    return memory.memory_window(_turns(spark, d))


@query(f"SELECT conv_id, memory FROM {_MEMORY}")
def memory_context(spark, d):
    return memory.memory_context(_turns(spark, d))


@query(f"SELECT conv_id, memory FROM {_MEMORY} WHERE conv_id IS NOT NULL")
def memory_stream(spark, d):
    """The messages as a stream, run twice from one checkpoint."""
    folder = new_folder(spark, "memory-stream")
    for _ in range(2):
        stream.start_memory(spark, f"{d}/conversations.parquet", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return stream.current_memory(spark, f"{folder}/out")


@query(
    f"""SELECT c.conv_id, 'What about it?' AS question, CASE WHEN coalesce(memory, '') = '' THEN 'What about it?' ELSE 'Earlier in this conversation:' || chr(10) || memory || chr(10) || chr(10) || 'Question now:' || chr(10) || 'What about it?' || chr(10) || chr(10) || 'Earlier turns only say what it, this, that, the model or the result stands for.' END AS query
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN {_MEMORY} m USING (conv_id)"""
)
def contextual_query(spark, d):
    asked = table(spark, d, "conversations").select("conv_id").distinct().withColumn("question", F.lit("What about it?"))
    return memory.contextual_query(asked, memory.memory_context(_turns(spark, d)))


# ------------------------------------------------------------------ evidence


@query(
    f"""SELECT q_id, string_agg(chr(10) || '[Source ' || rank || ']' || chr(10) || 'File: ' || coalesce(source, 'Unknown') || chr(10) || 'Page: ' || page || chr(10) || 'Chunk: ' || chunk_id || chr(10) || 'Region: ' || region || chr(10) || 'Content type: ' || content_type || chr(10) || 'Evidence:' || chr(10) || left(text, 1800) || chr(10), chr(10) ORDER BY rank) AS context FROM {HYBRID} GROUP BY q_id"""
)
def evidence_context(spark, d):
    return evidence.evidence_context(_hybrid(spark, d))


_ANSWERS = f"(SELECT * FROM {fx.ANSWERS.sql(['q_id', 'answer', 'n_sources'])} UNION ALL SELECT * FROM {derived.ANSWERS})"


def _answers(spark, d):
    return fx.ANSWERS.spark(spark).unionByName(derived.answers(spark, d))


def s_cites(pattern: str) -> str:
    return rf"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '(?i)\[{pattern}\s+(\d+)\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND n_sources)))"


@query(f"SELECT q_id, array_to_string({s_cites('Source')}, ',') AS cited, array_to_string({s_cites('Visual Source')}, ',') AS cited_visual FROM {_ANSWERS}")
def citations(spark, d):
    rows = _answers(spark, d)
    cite = lambda v: F.array_join(evidence.citations(F.col("answer"), F.col("n_sources"), v), ",")
    return rows.select("q_id", cite(False).alias("cited"), cite(True).alias("cited_visual"))


_NEEDS = f"len({s_cites('Source')}) = 0"
_FIRST = "range(1, least(2, n_sources) + 1)"


@query(
    f"""SELECT q_id, CASE WHEN {_NEEDS} AND n_sources > 0 THEN answer || chr(10) || chr(10) || array_to_string(list_transform({_FIRST}, lambda i: '[Source ' || i || ']'), '') ELSE answer END AS answer, array_to_string(CASE WHEN {_NEEDS} THEN {_FIRST} ELSE {s_cites('Source')} END, ',') AS cited FROM {_ANSWERS}"""
)
def citation_repair(spark, d):
    return evidence.repair_citations(_answers(spark, d)).withColumn("cited", F.array_join("cited", ","))


@query(f"SELECT q_id, CAST(rank AS INTEGER) AS rank, page, chunk_id, 'Unknown' AS section, 'Unknown' AS subsection, region, round(final_score, 6) AS score, source, source AS document FROM {HYBRID}")
def api_sources(spark, d):
    return evidence.api_sources(_hybrid(spark, d)).withColumn("score", F.round("score", 6))


@query("SELECT source, min(doc_id) AS first_chunk FROM documents WHERE coalesce(source, '') <> '' GROUP BY source")
def doc_sources(spark, d):
    return evidence.doc_sources(_doc_chunks(spark, d))


DOC_EVIDENCE = f"(SELECT source, CAST(r AS INTEGER) AS place, page, chunk_id, text FROM (SELECT source, page, chunk_id, {_T} AS text, row_number() OVER (PARTITION BY source ORDER BY length({_T}) DESC, chunk_id) AS r FROM {DOC_CHUNKS} WHERE length({_T}) >= 80) WHERE r <= 4)"


@query(f"SELECT * FROM {DOC_EVIDENCE}")
def doc_evidence(spark, d):
    return evidence.doc_evidence(_doc_chunks(spark, d))


@query(
    f"""SELECT CAST(row_number() OVER (ORDER BY first_chunk) AS INTEGER) AS number, s.source, coalesce(t.text, 'No text chunk of this document is long enough to quote.') AS text, 'Nothing was read from the images of this document.' AS visual FROM (SELECT source, min(doc_id) AS first_chunk FROM documents WHERE coalesce(source, '') <> '' GROUP BY source) s
    LEFT JOIN (SELECT source, left(string_agg('Page ' || page || ' (Chunk ' || chunk_id || '):' || chr(10) || left(text, 1400), chr(10) || chr(10) ORDER BY place), 4500) AS text FROM {DOC_EVIDENCE} GROUP BY source) t ON s.source = t.source"""
)
def doc_compare_context(spark, d):
    return evidence.doc_compare_context(_doc_chunks(spark, d))


# ------------------------------------------------------------------ evaluation

_CASES = f"(SELECT * FROM {fx.CASES.sql(['name', 'category', 'answer', 'expected_terms'])} UNION ALL SELECT * FROM {derived.CASES})"


def s_eval(x: str) -> str:
    return s_strip(rf"regexp_replace(translate(lower({x}), '_\', '  '), '\s+', ' ', 'g')")


_HIT = f"list_filter(expected_terms, lambda t: contains({s_eval('answer')}, {s_eval('t')}))"
_MISS = f"list_filter(expected_terms, lambda t: NOT contains({s_eval('answer')}, {s_eval('t')}))"
EVAL = f"(SELECT name, category, CASE WHEN len(expected_terms) = 0 THEN 0.0 ELSE len({_HIT}) / CAST(len(expected_terms) AS DOUBLE) END AS score, array_to_string({_HIT}, ',') AS matched, array_to_string({_MISS}, ',') AS missing FROM {_CASES})"


@query(f"SELECT name, round(score, 6) AS score, score >= 0.7 AS passed, matched, missing FROM {EVAL}")
def eval_terms(spark, d):
    return evaluation.eval_terms(fx.CASES.spark(spark).unionByName(derived.cases(spark, d))).select("name", F.round("score", 6).alias("score"), "passed", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS n_passed, count(*) FILTER (quality <> 1) AS n_failed, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS accuracy FROM labels")
def eval_summary(spark, d):
    results = table(spark, d, "labels").select((F.col("quality") == 1).alias("passed"))
    return evaluation.eval_summary(results).withColumn("accuracy", F.round(F.col("accuracy").cast("double"), 6))


@query("SELECT lang AS category, count(*) AS total, count(*) FILTER (quality = 1) AS n_passed, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def eval_by_category(spark, d):
    results = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("category")), "doc_id").select("category", (F.col("quality") == 1).alias("passed"))
    return evaluation.eval_by_category(results).withColumn("accuracy", F.round(F.col("accuracy").cast("double"), 6))


def _case_turns(spark, d):
    """(conv_id, turn, question): each text of the benchmark, then what the conversation of that number first asks."""
    first = _asked(spark, d).select(F.col("q_id").alias("conv_id"), F.lit(1).alias("turn"), "question")
    said = table(spark, d, "conversations").filter("role = 'user' AND trim(text) <> ''").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    return first.unionByName(said.join(first.select("conv_id"), "conv_id", "left_semi").withColumn("turn", F.lit(2)))


def _best_page(spark, d):
    """Answers with the beginning of the best page for the question in the light of memory."""
    index, pages = _index(spark, d), _doc_chunks(spark, d, dealt=False).select("chunk_id", F.left("text", F.lit(200)).alias("answer"))

    def answer(asked, turns):
        query = memory.contextual_query(asked, memory.memory_context(turns)).select(F.col("conv_id").alias("q_id"), F.col("query").alias("question"))
        best = retrieval.bm25_top(pages, query, 1, index).select(F.col("q_id").alias("conv_id"), "chunk_id")
        return pages.join(F.broadcast(best), "chunk_id").select("conv_id", "answer", F.col("answer").alias("spoken"))  # a row a question

    return answer


def s_best(questions: str) -> str:
    """(q_id, answer) of the best page for each question."""
    return f"(SELECT q_id, left(text, 200) AS answer FROM (SELECT q_id, chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY round(bm25, 6) DESC, chunk_id) AS r FROM {s_bm25(questions)}) JOIN documents ON doc_id = chunk_id WHERE r = 1)"


_FIRST_Q = "(SELECT item_id AS q_id, text AS question FROM benchmark)"
_FIRST_SAID = f"(SELECT q_id, question, answer FROM {_FIRST_Q} JOIN {s_best(_FIRST_Q)} USING (q_id))"
_FOLLOWED = f"""(SELECT u.q_id, u.question AS asked, b.text AS first, CASE WHEN coalesce(answer, '') = '' THEN u.question ELSE 'Earlier in this conversation:' || chr(10) || left('User: ' || f.question || chr(10) || 'Assistant: ' || left(answer, 1000), 3500) || chr(10) || chr(10) || 'Question now:' || chr(10) || u.question || chr(10) || chr(10) || 'Earlier turns only say what it, this, that, the model or the result stands for.' END AS question
    FROM (SELECT conv_id AS q_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id) u JOIN benchmark b ON b.item_id = u.q_id LEFT JOIN {_FIRST_SAID} f ON f.q_id = u.q_id)"""
_EVAL_ROWS = f"(SELECT q_id, coalesce(answer, '') AS answer, list_concat(list_concat(w[1:1], w[3:3]), ['absent']) AS expected_terms FROM (SELECT f.q_id, s.answer, {derived.S_WORDS.replace('coalesce(text', 'coalesce(f.first')} AS w FROM {_FOLLOWED} f LEFT JOIN {s_best(_FOLLOWED)} s ON s.q_id = f.q_id))"


@query(f"SELECT q_id AS conv_id, answer, round(CAST(len({_HIT}) AS DOUBLE) / len(expected_terms), 6) AS score, CAST(len({_HIT}) AS DOUBLE) / len(expected_terms) >= 0.7 AS passed, array_to_string({_MISS}, ',') AS missing FROM {_EVAL_ROWS}")
def eval_conversations(spark, d):
    """Two rounds over all cases: the second question is asked in the light of the first answer, and scored."""
    turns = _case_turns(spark, d)
    said = evaluate.converse(turns, _best_page(spark, d))
    first = turns.filter("turn = 1").select("conv_id", text.words(F.col("question")).alias("w"))
    terms = F.concat(F.slice("w", 1, 1), F.slice("w", 3, 1), F.array(F.lit("absent")))
    expected = turns.filter("turn = 2").join(first, "conv_id").select("conv_id", F.lit(2).cast("long").alias("turn"), terms.alias("expected_terms"))
    return evaluate.scored(said, expected).select("conv_id", "answer", F.round("score", 6).alias("score"), "passed", F.array_join("missing", ",").alias("missing"))

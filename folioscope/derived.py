"""Inputs that the driver's tables lack, derived from them by rule: beside the literal
rows of :mod:`.fixtures`, so that they grow with the tables.

Each is built twice, as a DataFrame and as a DuckDB relation of the same columns.
Words are runs without white space; layouts, scores and file names follow from ids
and places in the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import words

#: Words of a page of boxes, and boxes of a row.
PAGE_WORDS, ROW_WORDS = 400, 8

S_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; one that is scanned in fewer parts than there are cores is dealt out to them."""
    df, cores = spark.read.parquet(f"{d}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def _worded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("w"))


# ------------------------------------------------------------------ recogniser output


def tsv(spark: SparkSession, d: str) -> DataFrame:
    """(key, line_no, line): every word of a document as a line of a recogniser, each fifth without confidence."""
    rows = _worded(spark, d).select("doc_id", F.posexplode_outer("w").alias("i", "x")).filter("x IS NOT NULL")
    line = F.expr(r"concat('5\t1\t1\t1\t1\t', i, '\t0\t0\t1\t1\t', if(i % 5 = 4, -1, (doc_id + i) % 101), '\t', x)")
    return rows.select((F.col("doc_id") + 1_000).alias("key"), F.col("i").alias("line_no"), line.alias("line"))


#: What the lines above say: words with confidence, and its mean rounded half up.
TSV_TEXT = f"""(SELECT doc_id + 1000 AS key, string_agg(x, ' ' ORDER BY i) AS text, CAST((200 * sum((doc_id + i) % 101) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS confidence
    FROM (SELECT doc_id, w[i + 1] AS x, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, {S_WORDS} AS w FROM documents))) WHERE i % 5 <> 4 GROUP BY doc_id)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(key, ord, text, confidence, quality): a document as read badly, better and whole."""
    text = "CASE ord WHEN 0 THEN left(text, 30) WHEN 1 THEN left(text, 60) ELSE text END"
    rows = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, range(3)))).alias("ord"))
    return rows.selectExpr("10000000 + doc_id AS key", "ord", f"{text} AS text", "CAST((doc_id * (ord + 3)) % 101 AS DOUBLE) AS confidence", "((doc_id + ord * 5) % 7) / 4.0D AS quality")


CANDIDATES = "(SELECT 10000000 + doc_id AS key, ord, CASE ord WHEN 0 THEN left(text, 30) WHEN 1 THEN left(text, 60) ELSE text END AS text, CAST((doc_id * (ord + 3)) % 101 AS DOUBLE) AS confidence, ((doc_id + ord * 5) % 7) / 4.0e0 AS quality FROM documents, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS ord))"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(line_id, ord, engine, language, text, confidence): each line of a document as three engines read it."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("i", "line")).filter("line IS NOT NULL")
    rows = rows.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("ord"))
    return rows.selectExpr(
        "10000000 + doc_id * 100000 + i AS line_id", "ord", "if(ord = 1, 'tesseract', 'paddle') AS engine", "if(ord = 2, 'hindi', 'latin') AS language", "if(ord = 1, replace(line, 'e', '3'), line) AS text",
        "((doc_id + i + 31 * ord) % 101) / 100.0D AS confidence",
    )


LINES = """(SELECT 10000000 + doc_id * 100000 + i AS line_id, ord, CASE WHEN ord = 1 THEN 'tesseract' ELSE 'paddle' END AS engine, CASE WHEN ord = 2 THEN 'hindi' ELSE 'latin' END AS language,
    CASE WHEN ord = 1 THEN replace(l[i + 1], 'e', '3') ELSE l[i + 1] END AS text, ((doc_id + i + 31 * ord) % 101) / 100.0e0 AS confidence
    FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS ord))"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(page, boxes): the words of a document laid out in rows, 400 to a page; some are too small to be text."""
    rows = _worded(spark, d).filter("size(w) > 0").select("doc_id", "w", F.explode(F.expr(f"sequence(0, (size(w) - 1) div {PAGE_WORDS})")).alias("p"))
    box = f"named_struct('x1', CAST(i % {ROW_WORDS} * 60 AS INT), 'y1', CAST(i div {ROW_WORDS} * 40 AS INT), 'x2', CAST(i % {ROW_WORDS} * 60 + 4 + least(length(x), 12) * 3 AS INT), 'y2', CAST(i div {ROW_WORDS} * 40 + if(i % 11 = 10, 4, 20) AS INT))"
    return rows.selectExpr("1000 + doc_id * 1000 + p AS page", f"transform(slice(w, p * {PAGE_WORDS} + 1, {PAGE_WORDS}), (x, i) -> {box}) AS boxes")


_BOX = f"{{'x1': CAST((i - 1) % {ROW_WORDS} * 60 AS INTEGER), 'y1': CAST((i - 1) // {ROW_WORDS} * 40 AS INTEGER), 'x2': CAST((i - 1) % {ROW_WORDS} * 60 + 4 + least(length(x), 12) * 3 AS INTEGER), 'y2': CAST((i - 1) // {ROW_WORDS} * 40 + CASE WHEN (i - 1) % 11 = 10 THEN 4 ELSE 20 END AS INTEGER)}}"
BOXES = f"(SELECT 1000 + doc_id * 1000 + p AS page, list_transform(w[p * {PAGE_WORDS} + 1:p * {PAGE_WORDS} + {PAGE_WORDS}], lambda x, i: {_BOX}) AS boxes FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // {PAGE_WORDS} + 1)) AS p FROM (SELECT doc_id, {S_WORDS} AS w FROM documents) WHERE len(w) > 0))"


def line_boxes_sql(clean: str) -> str:
    """Lines of the pages above, from their clean boxes: a gap of over three heights parts a row."""
    return f"""SELECT page, CAST(line AS INTEGER) AS line, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids
        FROM (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y1, x1) - 1 AS line FROM (SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY page, y1 ORDER BY x1) <= 60 THEN 0 ELSE 1 END AS new FROM {clean} WHERE page >= 1000)) GROUP BY page, line"""


# ------------------------------------------------------------------ pages with layout

_ROWS = "transform(split(coalesce(text, ''), '\\n'), l -> split(l, ', '))"
_IMAGE = "named_struct('path', if(doc_id % 6 = 4 AND k = 1, '', concat('i_', doc_id, '_', k, '.png')), 'width', CAST(doc_id % 4 * 100 AS INT), 'height', 50, 'extension', if(k = 2, null, 'png'))"


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Page elements: documents as pages, every third from OCR, with images, tables of their lines, or a rendering."""
    return table(spark, d, "documents").selectExpr(
        "concat(source, '.pdf') AS source", "CAST(100 + doc_id AS INT) AS page", "text", "doc_id % 3 = 0 AS ocr_used", "CAST(doc_id % 101 AS DOUBLE) AS ocr_confidence", "(doc_id % 5) / 4.0D AS ocr_quality",
        "if(doc_id % 3 = 2, named_struct('path', concat('p_', doc_id, '.png')), null) AS page_image",
        f"if(doc_id % 3 = 0, CAST(array() AS array<struct<path:string,width:int,height:int,extension:string>>), transform(sequence(1, CAST(doc_id % 3 AS INT)), k -> {_IMAGE})) AS images",
        f"CASE doc_id % 4 WHEN 0 THEN CAST(array() AS array<struct<rows:array<array<string>>>>) WHEN 1 THEN array(named_struct('rows', {_ROWS})) ELSE array(named_struct('rows', CAST(array() AS array<array<string>>)), named_struct('rows', {_ROWS})) END AS tables",
        "doc_id % 2 = 0 AS has_visual_content", "1000 + doc_id AS chunk_id",
    )


_S_ROWS = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: string_split(l, ', '))"
_S_IMAGE = "{'path': CASE WHEN doc_id % 6 = 4 AND k = 1 THEN '' ELSE 'i_' || doc_id || '_' || k || '.png' END, 'width': CAST(doc_id % 4 * 100 AS INTEGER), 'height': 50, 'extension': CASE WHEN k = 2 THEN NULL ELSE 'png' END}"
ELEMENTS = f"""(SELECT source || '.pdf' AS source, CAST(100 + doc_id AS INTEGER) AS page, text, doc_id % 3 = 0 AS ocr_used, CAST(doc_id % 101 AS DOUBLE) AS ocr_confidence, (doc_id % 5) / 4.0e0 AS ocr_quality,
    CASE WHEN doc_id % 3 = 2 THEN {{'path': 'p_' || doc_id || '.png'}} END AS page_image, list_transform(range(1, doc_id % 3 + 1), lambda k: {_S_IMAGE}) AS images,
    CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN [{{'rows': {_S_ROWS}}}] ELSE [{{'rows': []}}, {{'rows': {_S_ROWS}}}] END AS tables, doc_id % 2 = 0 AS has_visual_content, 1000 + doc_id AS chunk_id FROM documents)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Layout blocks of the older format: a document is a block, headers and blocks without region among them."""
    region = "element_at(array('header', 'abstract', 'body', null), CAST(doc_id % 4 + 1 AS INT))"
    return table(spark, d, "documents").selectExpr("source", "CAST(if(doc_id % 7 = 0, null, doc_id) AS INT) AS page", f"{region} AS region", "if(doc_id % 2 = 0, null, concat('Section ', doc_id)) AS section", "'x' AS subsection", "text")


BLOCKS = "(SELECT source, CAST(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id END AS INTEGER) AS page, (['header', 'abstract', 'body', NULL])[doc_id % 4 + 1] AS region, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'Section ' || doc_id END AS section, 'x' AS subsection, text FROM documents)"


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("1000 + doc_id AS id", "CAST(coalesce(n_chars, 0) % 3000 + 1 AS INT) AS width", "CAST(doc_id % 2000 + 1 AS INT) AS height")


SIZES = "(SELECT 1000 + doc_id AS id, CAST(coalesce(n_chars, 0) % 3000 + 1 AS INTEGER) AS width, CAST(doc_id % 2000 + 1 AS INTEGER) AS height FROM documents)"


# ------------------------------------------------------------------ questions and answers


def pages_found(spark: SparkSession, d: str) -> DataFrame:
    """(q_id, rank, source, page): for each text of the benchmark two pages of ``elements``."""
    asked = table(spark, d, "benchmark").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    met = asked.join(docs, F.col("doc_id") == F.col("item_id") + F.col("rank") - 1)
    return met.selectExpr("1000 + item_id AS q_id", "rank", "concat(source, '.pdf') AS source", "CAST(100 + doc_id AS INT) AS page")


PAGES_FOUND = "(SELECT 1000 + item_id AS q_id, rank, source || '.pdf' AS source, 100 + doc_id AS page FROM benchmark, (SELECT unnest([1, 2]) AS rank) JOIN documents ON doc_id = item_id + rank - 1)"


def answers(spark: SparkSession, d: str) -> DataFrame:
    """(q_id, answer, n_sources): what assistants said, two in three times with citations."""
    said = table(spark, d, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    return said.selectExpr("10000000 + conv_id * 1000 + turn AS q_id", "if(turn % 3 = 0, text, concat(text, ' [Source ', turn % 4, '] [Visual Source ', conv_id % 3, ']')) AS answer", "CAST(conv_id % 4 AS INT) AS n_sources")


ANSWERS = "(SELECT 10000000 + conv_id * 1000 + turn AS q_id, CASE WHEN turn % 3 = 0 THEN text ELSE text || ' [Source ' || (turn % 4) || '] [Visual Source ' || (conv_id % 3) || ']' END AS answer, CAST(conv_id % 4 AS INTEGER) AS n_sources FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)"


def cases(spark: SparkSession, d: str) -> DataFrame:
    """(name, category, answer, expected_terms): documents that should hold their own first and third word."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", words(F.col("text")).alias("w"))
    return docs.selectExpr("concat('doc ', doc_id) AS name", "coalesce(lang, 'none') AS category", "coalesce(text, '') AS answer", "concat(slice(w, 1, 1), slice(w, 3, 1), array('absent')) AS expected_terms")


CASES = f"(SELECT 'doc ' || doc_id AS name, coalesce(lang, 'none') AS category, coalesce(text, '') AS answer, list_concat(list_concat(w[1:1], w[3:3]), ['absent']) AS expected_terms FROM (SELECT doc_id, lang, text, {S_WORDS} AS w FROM documents))"

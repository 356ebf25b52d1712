"""Visual evidence: which page images to look at for a question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import routing
from . import models

MOST_PAGES = 2


def image_chunks(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(source, page, chunk_id, path) of embedded images; ``files`` (path) keeps those that exist."""
    rows = chunks.filter("content_type = 'image'").select("source", "page", "chunk_id", F.explode("images").alias("im")).select("source", "page", "chunk_id", F.col("im.path").alias("path"))
    rows = rows.filter(F.coalesce("path", F.lit("")) != "")
    return rows if files is None else rows.join(files, "path", "left_semi")


def available_pages(chunks: DataFrame, by_source: bool = True) -> DataFrame:
    """One image per page: the last chunk's first embedded image, else the first chunk's rendering.

    ``by_source`` keeps documents apart; without it pages of all documents share numbers.
    """
    keys = ["source", "page"] if by_source else ["page"]
    own = F.try_element_at(F.filter("images", lambda x: F.coalesce(x["path"], F.lit("")) != ""), F.lit(1))["path"]
    df = chunks.filter("page IS NOT NULL").withColumn("_own", own).withColumn("_page", F.nullif(F.col("page_image.path"), F.lit("")))
    last = F.max_by(F.struct("chunk_id", "source", F.col("_own").alias("path")), F.when(F.col("_own").isNotNull(), F.col("chunk_id")))
    first = F.min_by(F.struct("chunk_id", "source", F.col("_page").alias("path")), F.when(F.col("_page").isNotNull(), F.col("chunk_id")))
    got = df.groupBy(*keys).agg(last.alias("a"), first.alias("b")).withColumn("x", F.coalesce("a", "b")).filter("x IS NOT NULL")
    return got.select("x.source", "page", "x.chunk_id", "x.path")


def table_pages(chunks: DataFrame) -> DataFrame:
    return chunks.filter("content_type = 'table' AND page IS NOT NULL").select("source", "page").distinct()


def select_pages(questions: DataFrame, results: DataFrame, pages: DataFrame, tables: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(q_id, place, source, page, path): the page images for each question.

    A page that is asked for and exists is the only one.  Else, in this order:
    the first table pages for a question about a numbered table, pages of the
    retrieved chunks, the first table page for a question about tables, the
    first pages for a question about images.
    """
    q = questions.select("q_id", routing.requested_page(F.col("question")).alias("asked"), routing.table_number(F.col("question")).alias("numbered"), routing.is_table(F.col("question")).alias("tabular"), routing.is_visual(F.col("question")).alias("looking"))
    # A few pages: found by a distributed top-k, then numbered.
    first = lambda df: df.orderBy("page", "source").limit(most).withColumn("n", F.row_number().over(Window.orderBy("page", "source")))
    have = pages.select("source", "page", "path")
    tabled = first(tables).join(have, ["source", "page"]).select("source", "page", "path", "n")
    some = first(have.select("source", "page", "path"))
    part = lambda level, df: df.select("q_id", F.lit(level).alias("level"), "n", "source", "page", "path")
    asked = part(0, q.filter("asked IS NOT NULL").join(have, F.col("asked") == F.col("page")).withColumn("n", F.row_number().over(Window.partitionBy("q_id").orderBy("source"))).filter("n = 1"))
    numbered = part(1, q.filter("numbered IS NOT NULL").crossJoin(F.broadcast(tabled)))
    found = part(2, results.select("q_id", F.col("rank").alias("n"), "source", "page").join(have, ["source", "page"]))
    tabular = part(3, q.filter("tabular").crossJoin(F.broadcast(tabled.filter("n = 1"))))
    looking = part(4, q.filter("looking").crossJoin(F.broadcast(some)))
    every = asked.unionByName(numbered).unionByName(found).unionByName(tabular).unionByName(looking)
    lowest = F.min("level").over(Window.partitionBy("q_id"))
    # Numbered tables and evidence add up; the rest counts only if nothing came before.
    every = every.withColumn("_low", lowest).filter("level = _low OR (_low = 1 AND level = 2)")
    every = every.withColumn("_again", F.row_number().over(Window.partitionBy("q_id", "source", "page").orderBy("level", "n"))).filter("_again = 1")
    every = every.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy("level", "n", "source")))
    return every.filter(F.col("place") <= F.when(F.col("level") == 0, 1).otherwise(most)).select("q_id", "place", "source", "page", "path")


Analyser = Callable[[str, str], str | None]
ANALYSIS_CHARS = 1800


def image_prompt(question: Column) -> Column:
    """What to ask of a page image: the table that is asked for, any table, or the whole image."""
    number = routing.table_number(question)
    table = F.when(number.isNotNull(), F.concat(F.lit("Read table "), number, F.lit(" on this page.")))
    return F.concat(F.coalesce(table, F.when(routing.is_table(question), "Read the table that bears on the question."), F.lit("Describe what on this page bears on the question.")), F.lit("\nQuestion: "), question)


def analyze_pages(selected: DataFrame, questions: DataFrame, analyser: Analyser) -> DataFrame:
    """(q_id, number, source, page, chunk_id, analysis): one model call per prompt and image.

    Images that cannot be read go; the others keep their numbers.
    """
    df = models.ask(selected.join(questions, "q_id").withColumn("_prompt", image_prompt(F.col("question"))), ["_prompt", "path"], analyser, answer="analysis")
    df = df.withColumn("analysis", F.left("analysis", F.lit(ANALYSIS_CHARS)))
    return df.filter(F.coalesce("analysis", F.lit("")) != "").select("q_id", F.col("place").alias("number"), "source", "page", F.lit(None).cast("long").alias("chunk_id"), "analysis")


def resize_dims(images: DataFrame, width: int = 850, height: int = 1100) -> DataFrame:
    """New sizes that fit, never larger than the old."""
    scale = F.least(width / F.col("width"), height / F.col("height"), F.lit(1.0))
    return images.select("*", F.greatest(F.lit(1), F.floor(F.col("width") * scale)).cast("int").alias("new_width"), F.greatest(F.lit(1), F.floor(F.col("height") * scale)).cast("int").alias("new_height"))

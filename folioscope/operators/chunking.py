"""Chunking: fixed windows, sentence packing, tables and images as text, page chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_chunk, sentences, strip
from ..sources.pages import dense_ids

TARGET, MOST, LEAST = 90, 140, 40


def fixed_chunks(df: DataFrame, size: int = 1000, step: int = 800) -> DataFrame:
    """(..., chunk, text): overlapping windows of characters, stripped, empty ones left out."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))
    rows = df.filter(F.length("text") > 0).select("*", F.posexplode(starts).alias("chunk", "_at"))
    rows = rows.withColumn("text", strip(F.substring("text", F.col("_at") + 1, F.lit(size)))).drop("_at")
    return rows.filter("text <> ''")


_RUN = "struct<at:int,len:int,n:int>"


def _runs(items: Column, joins: Callable[[Column, Column], Column]) -> Column:
    """Neighbouring runs (at, len, n) joined in order where ``joins(words so far, words)`` says so.

    A fold over numbers: texts stay out of the accumulator, which grows by one
    run for each that is closed.
    """
    zero = F.struct(F.array().cast(f"array<{_RUN}>").alias("done"), F.lit(None).cast(_RUN).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["open"]
        fits = last.isNotNull() & joins(last["n"], x["n"])
        joined = F.struct(last["at"].alias("at"), (last["len"] + x["len"]).alias("len"), (last["n"] + x["n"]).alias("n"))
        done = F.when(last.isNull() | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(x).alias("open"))

    return F.aggregate(items, zero, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def pack_runs(parts: Column, target: int = TARGET, least: int = LEAST, most: int = MOST) -> Column:
    """Runs of sentences (first, how many, words), packed in order until the next
    would pass ``target`` words; then a pack of fewer than ``least`` words joins
    the one before if both fit in ``most`` (0: packs stay as they are)."""
    one = F.transform(parts, lambda p, i: F.struct(i.cast("int").alias("at"), F.lit(1).alias("len"), F.regexp_count(p, F.lit(r"(?U)\S+")).alias("n")))
    packs = _runs(F.coalesce(one, F.array().cast(f"array<{_RUN}>")), lambda n, more: n + more <= target)
    return _runs(packs, lambda n, more: (more < least) & (n + more <= most)) if most else packs


def pack_sentences(parts: Column, target: int = TARGET, least: int = LEAST, most: int = MOST) -> Column:
    """(text, n) of the packs of a column of sentences."""
    joined = lambda r: F.array_join(F.slice(parts, r["at"] + 1, r["len"]), " ")
    return F.transform(pack_runs(parts, target, least, most), lambda r: F.struct(joined(r).alias("text"), r["n"].alias("n")))


def with_packs(df: DataFrame, text: Column, target: int = TARGET, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Add ``packs``: (text, n) of the packed sentences of ``text``.

    Sentences are a column of their own, so each text is split once.
    """
    df = df.withColumn("_sentences", sentences(text))
    return df.withColumn("packs", pack_sentences(F.col("_sentences"), target, least, most)).drop("_sentences")


def sentence_chunks(df: DataFrame, merge: bool = True) -> DataFrame:
    """(..., chunk, text, n_words) of every text."""
    packed = with_packs(df, F.col("text"), most=MOST if merge else 0).drop("text")
    # Outer, then filtered: for an inner one the optimiser adds a filter that
    # works the packs out a second time, before any exchange.
    rows = packed.select("*", F.posexplode_outer("packs").alias("chunk", "_c")).drop("packs").filter("chunk IS NOT NULL")
    return rows.withColumn("text", F.col("_c.text")).withColumn("n_words", F.col("_c.n")).drop("_c")


def table_text(rows: Column) -> Column:
    """``Row i: a | b`` lines; rows whose cells join to nothing are left out."""

    def line(row: Column, i: Column) -> Column:
        cells = F.array_join(F.transform(row, clean_chunk), " | ")
        return F.when((F.size(row) > 0) & (strip(cells) != ""), F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), cells))

    return F.array_join(F.filter(F.transform(rows, line), lambda x: x.isNotNull()), "\n")


def tables_text(tables: Column) -> Column:
    """All tables under their numbers, blank ones left out."""

    def one(t: Column, i: Column) -> Column:
        text = table_text(t["rows"])
        return F.when(strip(text) != "", F.concat(F.lit("TABLE "), (i + 1).cast("string"), F.lit("\n"), text))

    return F.array_join(F.filter(F.transform(tables, one), lambda x: x.isNotNull()), "\n\n")


def images_text(images: Column) -> Column:
    """One line per embedded image; dimensions where both are known."""

    def one(im: Column, i: Column) -> Column:
        size = F.when((im["width"] != 0) & (im["height"] != 0), F.concat(F.lit(", dimensions "), im["width"].cast("string"), F.lit("x"), im["height"].cast("string")))
        return F.concat(F.lit("Embedded image "), (i + 1).cast("string"), F.lit(" ("), F.coalesce(im["extension"], F.lit("unknown")), F.lit(")"), F.coalesce(size, F.lit("")))

    return F.array_join(F.transform(images, one), "\n")


#: What a chunk keeps of its page, and the value where the page has none.
PAGE_FIELDS = {"ocr_used": "boolean", "ocr_languages": "string", "ocr_confidence": "double", "ocr_quality": "double", "page_image": None, "images": None, "tables": None}


def page_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of page elements: text, then table, image and visual page, with dense ids.

    A page without source counts as ``Unknown``, one without number as page 0;
    every chunk carries its page's OCR and layout fields (languages only where
    OCR was used).
    """
    for c, kind in PAGE_FIELDS.items():
        if kind and c not in pages.columns:
            pages = pages.withColumn(c, F.lit(None).cast(kind))
    df = pages.withColumn("source", F.coalesce("source", F.lit("Unknown"))).withColumn("page", F.coalesce("page", F.lit(0)))
    df = df.withColumn("text", clean_chunk(F.col("text"))).withColumn("ocr_used", F.coalesce("ocr_used", F.lit(False)))
    df = df.withColumn("ocr_languages", F.when(F.col("ocr_used"), F.col("ocr_languages"))).withColumn("ocr_confidence", F.coalesce("ocr_confidence", F.lit(0.0))).withColumn("ocr_quality", F.coalesce("ocr_quality", F.lit(0.0)))
    df = df.withColumn("image_count", F.coalesce(F.array_size("images"), F.lit(0))).withColumn("table_count", F.coalesce(F.array_size("tables"), F.lit(0)))
    df = with_packs(df, F.col("text"))
    item = lambda order, kind, region, text, visual: F.struct(F.lit(order).alias("kind_order"), F.lit(kind).alias("content_type"), F.lit(region).alias("region"), text.alias("text"), visual.alias("visual"))
    table, image = tables_text(F.col("tables")), images_text(F.col("images"))
    page = F.col("page").cast("string")
    # The texts of chunks for pages and images.
    shown = F.concat(F.lit("Visual content on page "), page, F.lit(".\n"), image)
    blank = F.concat(F.lit("Visual page "), page, F.lit(" from "), F.col("source"), F.lit(". Rendered page image available."))
    yes, flag = F.lit(True), F.coalesce("has_visual_content", F.lit(False))
    items = F.concat(
        F.transform(F.filter("packs", lambda p: strip(p["text"]) != ""), lambda p: item(0, "text", "body", p["text"], flag)),
        F.when(table != "", F.array(item(1, "table", "table", table, yes))).otherwise(F.array()),
        F.when(image != "", F.array(item(2, "image", "image", shown, yes))).otherwise(F.array()),
        F.when(F.col("page_image").isNotNull() & (F.col("text") == ""), F.array(item(3, "visual_page", "visual_page", blank, yes))).otherwise(F.array()),
    )
    kept = [*PAGE_FIELDS, "image_count", "table_count"]
    rows = df.select("source", "page", *kept, F.posexplode_outer(items).alias("seq", "c")).filter("seq IS NOT NULL")
    unknown = F.lit("Unknown")
    rows = rows.select("source", "page", "seq", "c.content_type", "c.region", unknown.alias("section"), unknown.alias("subsection"), F.col("c.text").alias("text"), F.col("c.visual").alias("has_visual_content"), *kept)
    return dense_ids(rows, ["source", "page", "seq"], "chunk_id", "page").drop("seq")


def legacy_chunks(blocks: DataFrame) -> DataFrame:
    """Chunks of (source, page, region, section, subsection, text) blocks: a header stays whole, others by sentences.

    Fields that are missing or null get their defaults, but for the source.
    """
    for c, value in (("region", "body"), ("page", 0), ("section", "Unknown"), ("subsection", "Unknown")):
        blocks = blocks.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in blocks.columns else F.lit(value))
    df = with_packs(blocks.withColumn("text", clean_chunk(F.col("text"))).filter("text <> ''"), F.col("text"))
    parts = F.when(F.col("region") == "header", F.array("text")).otherwise(F.transform("packs", lambda p: p["text"]))
    rows = df.select("source", "page", "region", "section", "subsection", F.posexplode_outer(parts).alias("chunk", "text")).filter("text <> ''")
    return rows.select("*", F.lit("text").alias("content_type"), F.lit(False).alias("ocr_used"), F.lit(False).alias("has_visual_content"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Counts by region, content type and source in one pass of grouping sets."""
    counted = chunks.withColumn("_table", (F.col("content_type") == "table").cast("long")).withColumn("_image", (F.col("content_type") == "image").cast("long"))
    sets = counted.groupingSets([["region"], ["content_type"], ["source"], []], "region", "content_type", "source")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("ocr_used").alias("n_ocr"), F.count_if("has_visual_content").alias("n_visual"), F.sum("_table").alias("n_table"), F.sum("_image").alias("n_image"), F.grouping_id().alias("_g"))
    by = F.when(F.col("_g") == 3, "region").when(F.col("_g") == 5, "content_type").when(F.col("_g") == 6, "source").otherwise("all")
    return out.select(by.alias("by"), F.coalesce("region", "content_type", "source", F.lit("all")).alias("value"), "n", "n_ocr", "n_visual", "n_table", "n_image")

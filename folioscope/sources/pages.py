"""Page-element sources and sinks.

Readers of PDF, images and OCR engines are plugins: a function from an Arrow
batch of files to page rows, run by ``mapInPandas``.  What they return follows
``PAGE_SCHEMA``; everything after them is plain DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_ingest, file_stem, strip
from .store import prefix_sums, written

IMAGE = "struct<image_index:int,path:string,width:int,height:int,extension:string>"
TABLE = "struct<table_index:int,rows:array<array<string>>>"
PAGE_SCHEMA = (
    "source string, page int, text string, ocr_used boolean, ocr_languages string, ocr_confidence double, ocr_quality double, ocr_psm int, ocr_variant string, "
    f"page_image struct<path:string,width:int,height:int,dpi:int>, images array<{IMAGE}>, tables array<{TABLE}>, image_count int, table_count int, has_text boolean, has_visual_content boolean"
)

PageReader = Callable[[str, bytes], list[dict]]


def find_files(spark: SparkSession, folder: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """Files of a folder by path; contents are read only where they are selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).orderBy("path")


def read_files(files: DataFrame, reader: PageReader) -> DataFrame:
    """(path, error, page element columns) by a reader plugin; a file that fails is one error row."""
    names = [f.name for f in files.sparkSession.createDataFrame([], PAGE_SCHEMA).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [{"path": path, "error": None, **dict.fromkeys(names), **page} for page in reader(path, bytes(content))]
                except Exception as e:  # noqa: BLE001  a bad file is skipped, and shown
                    rows.append({"path": path, "error": str(e), **dict.fromkeys(names)})
            yield pd.DataFrame(rows, columns=["path", "error", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, error string, {PAGE_SCHEMA}")


def pages_from_documents(docs: DataFrame) -> DataFrame:
    """The documents table as single pages: page number is the document's id."""
    return docs.select("source", F.col("doc_id").cast("int").alias("page"), "text")


def page_elements(pages: DataFrame) -> DataFrame:
    """Derived page fields from (source, page, text, page_image, images, tables)."""
    text = clean_ingest(F.col("text"))
    tables = F.filter(F.coalesce("tables", F.array().cast(f"array<{TABLE}>")), lambda t: F.size(t["rows"]) > 0)
    images = F.coalesce("images", F.array().cast(f"array<{IMAGE}>"))
    df = pages.withColumn("text", text).withColumn("tables", tables).withColumn("images", images)
    df = df.withColumn("image_count", F.size("images")).withColumn("table_count", F.size("tables")).withColumn("has_text", F.col("text") != "")
    return df.withColumn("has_visual_content", F.col("page_image").isNotNull() | (F.col("image_count") > 0) | (F.col("table_count") > 0))


def image_names(refs: DataFrame) -> DataFrame:
    """File names of page renderings and embedded images from (source, page, image_index, extension)."""
    stem = file_stem(F.col("source"))
    page = F.concat(stem, F.lit("_page_"), F.col("page").cast("string"))
    return refs.withColumn("page_file", F.concat(page, F.lit(".png"))).withColumn("image_file", F.concat(page, F.lit("_image_"), F.col("image_index").cast("string"), F.lit("."), F.col("extension")))


def nonblank_pages(pages: DataFrame) -> DataFrame:
    """Pages with text; numbers are those before blank ones went."""
    return pages.filter(strip(F.coalesce("text", F.lit(""))) != "")


def document_text(pages: DataFrame, width: int = 1_000) -> DataFrame:
    """(source, text): all pages of a source joined in order, each under a page marker.

    Pages of ``width`` numbers are joined first, wherever they are, and then these
    parts; only the parts and the text of a source meet in one task.
    """
    marked = F.concat(F.lit("\n--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))

    def joined(order: str, text: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.struct(order, text.alias("t"))))
        return F.when(F.count(text) > 0, F.array_join(F.transform(rows, lambda r: r["t"]), "\n"))  # pages without a number have no marker

    parts = pages.groupBy("source", F.floor(F.col("page") / width).cast("long").alias("part")).agg(joined("page", marked).alias("text"))
    return parts.groupBy("source").agg(F.coalesce(joined("part", F.col("text")), F.lit("")).alias("text"))


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Width and height of (x0, y0, x1, y1, text) layout blocks."""
    return blocks.withColumn("width", F.col("x1") - F.col("x0")).withColumn("height", F.col("y1") - F.col("y0"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Page elements from Parquet or, if the path says so, from multi-line JSON."""
    if path.rstrip("/").endswith(".json"):
        return spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(path)
    return spark.read.parquet(path)


BLOCK_SCHEMA = "source string, page int, region string, section string, subsection string, text string"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Legacy layout blocks (JSON list or lines); fields that are missing get their defaults here."""
    df = spark.read.schema(BLOCK_SCHEMA).option("multiLine", True).json(path)
    default = {"page": 0, "region": "body", "section": "Unknown", "subsection": "Unknown", "source": "Unknown"}
    return df.fillna(default)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Page elements of an ingestion manifest: {documents: [{source, pages: [...]}]}; a page's own source wins."""
    manifest = spark.read.schema(f"documents array<struct<source:string,page_count:int,pages:array<struct<{_as_fields(PAGE_SCHEMA)}>>>>").option("multiLine", True).json(path)
    docs = manifest.select(F.explode("documents").alias("d")).select(F.col("d.source").alias("_source"), F.explode("d.pages").alias("p"))
    return docs.select("_source", "p.*").withColumn("source", F.coalesce("source", "_source", F.lit("Unknown"))).drop("_source")


def _as_fields(schema: str) -> str:
    """``a int, b string`` as the inside of a struct type."""
    parts, start, depth = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(schema[start:i].strip())
            start = i + 1
    parts.append(schema[start:].strip())
    return ",".join(":".join(p.split(" ", 1)) for p in parts)


def write_page_results(results: DataFrame, path: str) -> None:
    """Results of recognised pages as JSON, each page in a folder named after its file with ``_hybrid``."""
    results.withColumn("file", F.concat(file_stem(F.col("source")), F.lit("_hybrid"))).write.mode("overwrite").partitionBy("file").json(path)


def read_page_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path).drop("file")


def write_table(df: DataFrame, path: str) -> None:
    """Every stage replaces its output."""
    df.write.mode("overwrite").parquet(path)


def dense_ids(df: DataFrame, order: list[str], name: str, page: str, width: int = 1_000) -> DataFrame:
    """One dense sequence over the whole table in the order of ``order``.

    ``order`` starts with a grouping column and ``page``; null groups and pages
    come first and keep their rows.  The table is written once; counts per range of
    ``width`` pages become starts by prefix sums over ranges of these ranges, so no
    window holds more than one range of rows or of counts.
    """
    group = order[0]
    rows = written(df.withColumn("_b", F.floor(F.col(page) / width)), "rows")
    counts = rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = prefix_sums(counts, [group, "_b"], "_n", "_first").select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), "_first")
    inside = Window.partitionBy(group, "_b").orderBy(*order[1:])
    met = rows.join(starts, rows[group].eqNullSafe(starts["_g"]) & rows["_b"].eqNullSafe(starts["_bb"]))
    return met.withColumn(name, F.col("_first") + F.row_number().over(inside) - 1).drop("_b", "_bb", "_g", "_first", "_n")

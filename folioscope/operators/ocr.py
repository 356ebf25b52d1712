"""OCR: candidate grids and selection, recogniser output, line layout, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.quality import line_quality, text_quality, valid_candidate
from ..functions.text import dominant_script, script_purity, strip, with_script_counts

VARIANTS = ("original", "autocontrast", "contrast", "sharpen", "threshold")
MODES = (3, 6, 11)
UNCERTAIN = 0.42
#: Rows of an Arrow batch, or those of the pages of one that came in more.
ROWS_OUT = 20_000


def ocr_grid(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Every image variant and segmentation mode to try on every page (15 rows a page)."""
    grid = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(m).alias("psm"), F.lit(i * len(MODES) + j).alias("ord")) for i, v in enumerate(VARIANTS) for j, m in enumerate(MODES)])
    return pages.select("*", F.inline(grid))


def parse_tsv(lines: DataFrame) -> DataFrame:
    """Text and mean confidence per key from recogniser lines (key, line_no, line)."""
    # Generated columns: plain ones would be copied into the pushed filter and split lines again.
    split = lines.select("key", "line_no", F.explode(F.array(F.split("line", "\t", -1))).alias("_p")).filter(F.size("_p") >= 12)
    conf, word = F.try_element_at("_p", F.lit(11)).try_cast("double"), strip(F.try_element_at("_p", F.lit(12)))
    words = split.select("key", "line_no", F.inline(F.array(F.struct(conf.alias("_c"), word.alias("_w"))))).filter((F.col("_c") >= 0) & (F.col("_w") != ""))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_w"))), lambda x: x["_w"]), " ")
    return words.groupBy("key").agg(text.alias("text"), F.round(F.avg("_c"), 2).alias("confidence"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Per key the candidate of best quality; those of 50 characters or more go first, ties to the earlier."""
    long = (F.length("text") >= 50).cast("int")
    best = F.max_by(F.struct("text", "confidence", "quality", "ord"), F.struct(long, F.col("quality"), -F.col("ord")))
    return candidates.filter(F.col("text") != "").groupBy("key").agg(best.alias("b")).select("key", "b.*")


def ocr_gate(pages: DataFrame, least: int = 40) -> DataFrame:
    """(native text, ocr text) -> the text to use: OCR where the native one is short and OCR found any."""
    use = (F.length(strip(F.coalesce("text", F.lit("")))) < least) & (F.coalesce("ocr_text", F.lit("")) != "")
    return pages.withColumn("ocr_used", use).withColumn("text", F.when(use, F.col("ocr_text")).otherwise(F.coalesce("text", F.lit("")))).drop("ocr_text")


def score_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("quality", text_quality(F.col("text"), F.col("confidence")))


def score_lines(lines: DataFrame) -> DataFrame:
    """Quality, purity, script and validity of (text, confidence, language) rows.

    Characters are counted once, in a generated column: white space has no
    part in the counts, so they serve the text however it is trimmed.
    """
    t, c, lang = F.col("text"), F.col("confidence"), F.col("language")
    rows, n = with_script_counts(lines, t)
    return rows.select("*", line_quality(t, c, lang, n).alias("quality"), script_purity(t, lang, n).alias("purity"), dominant_script(t, n).alias("script"), valid_candidate(t, c, lang, n).alias("valid")).drop("_n")


def select_lines(candidates: DataFrame) -> DataFrame:
    """Per line the best valid candidate; below the floor its text is withheld but its scores are kept.

    ``candidates`` lists all valid ones in their order, for audits.
    """
    df = score_lines(candidates).filter("valid")
    fields = ("engine", "language", "text", "confidence", "quality", "purity", "script")
    log = F.transform(F.sort_array(F.collect_list(F.struct("ord", *fields))), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    rows = df.groupBy("line_id").agg(log.alias("candidates"), F.max_by(F.struct("engine", "language", "text", "confidence", "quality", "purity", "script"), F.struct("quality", -F.col("ord"))).alias("b"), F.count(F.lit(1)).alias("n_candidates"))
    low = F.col("b.quality") < UNCERTAIN
    return rows.select("line_id", F.when(low, "uncertain").otherwise(F.col("b.engine")).alias("engine"), "b.language", F.when(low, "").otherwise(F.col("b.text")).alias("text"), "b.confidence", "b.quality", "b.purity", "b.script", "n_candidates", "candidates")


def clean_boxes(pages: DataFrame) -> DataFrame:
    """Boxes (x1, y1, x2, y2) of at least 8 by 5, with their place in the page's array as id."""
    rows = pages.select("page", F.posexplode("boxes").alias("id", "b"))
    return rows.select("page", "id", *[F.col(f"b.{c}").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]).filter("x2 - x1 >= 8 AND y2 - y1 >= 5")


def polygon_boxes(polygons: DataFrame) -> DataFrame:
    """The bounding box of each polygon (array of x, y), cut to whole numbers."""
    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    return polygons.select("*", F.array_min(xs).cast("int").alias("x1"), F.array_min(ys).cast("int").alias("y1"), F.array_max(xs).cast("int").alias("x2"), F.array_max(ys).cast("int").alias("y2"))


def _lines_of(boxes: list[tuple[int, int, int, int, int]], overlap: float, gap: float) -> list[list]:
    """Lines [x1, y1, x2, y2, sum of heights, boxes] of a page from its boxes (y1, x1, id, x2, y2) in order.

    Boxes come from top to bottom, so a line that ends above one is never met again.
    """
    lines: list[list] = []
    near: list[list] = []  # lines that reach below the top of the box
    row = None
    for b in boxes:
        y1, x1, _, x2, y2 = b
        best, most, tall = None, -1.0, max(1, y2 - y1)
        if y1 != row and overlap > 0:
            near, row = [line for line in near if line[3] > y1], y1
        for line in near:
            low, high = line[1], line[3]
            shared = max(0, min(y2, high) - max(y1, low))
            part = shared / min(tall, max(1, high - low))
            if part >= overlap and part > most and max(0, x1 - line[2]) <= gap * line[4] / len(line[5]):
                best, most = line, part
        if best is None:
            lines.append([x1, y1, x2, y2, tall, [b]])
            near.append(lines[-1])
        else:
            best[0], best[1], best[2], best[3] = min(best[0], x1), min(best[1], y1), max(best[2], x2), max(best[3], y2)
            best[4] += tall
            best[5].append(b)
    lines.sort(key=lambda line: line[1])
    return lines


def _by_page(boxes: DataFrame, overlap: float, gap: float, rows_of: Callable[[list], Iterable[tuple]], schema: pa.Schema) -> DataFrame:
    """Rows (page, line, ...) of the lines of each page; ``rows_of`` gives those of a line.

    Pages are dealt to tasks and sorted there, so that many of them come in one
    Arrow batch; a page is held while its boxes come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, out = None, [], []

        def close() -> None:
            for n, line in enumerate(_lines_of(held, overlap, gap)):
                out.extend((page, n, *r) for r in rows_of(line))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return made

        for b in batches:
            known, pages = pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False), pc.fill_null(b.column(0), 0).to_numpy()
            rows = list(zip(*(c.to_pylist() for c in b.columns[1:])))
            changes = np.flatnonzero((pages[1:] != pages[:-1]) | (known[1:] != known[:-1])) + 1
            starts = [0, *changes.tolist(), len(rows)] if rows else []
            for at, end in zip(starts, starts[1:]):
                now = int(pages[at]) if known[at] else None
                if now != page and held:
                    close()
                    held = []
                page = now
                held.extend(rows[at:end])
            if len(out) >= ROWS_OUT:
                yield batch()
        if held:
            close()
        if out:
            yield batch()

    order = ("y1", "x1", "id", "x2", "y2")
    rows = boxes.select(F.col("page").cast("long").alias("page"), *[F.col(c).cast("int").alias(c) for c in order])
    return rows.repartition("page").sortWithinPartitions("page", *order).mapInArrow(run, from_arrow_schema(schema))


_PLACE = [("page", pa.int64()), ("line", pa.int32())]
_CORNERS = [(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")]


def group_lines(boxes: DataFrame, overlap: float = 0.35, gap: float = 3.0) -> DataFrame:
    """(page, line, id and corners of a box) of text lines; a greedy pass per page."""

    def rows_of(line: list) -> Iterable[tuple]:
        return ((i, x1, y1, x2, y2) for y1, x1, i, x2, y2 in sorted(line[5], key=lambda b: b[1]))

    return _by_page(boxes, overlap, gap, rows_of, pa.schema([*_PLACE, ("id", pa.int32()), *_CORNERS]))


def text_lines(boxes: DataFrame, overlap: float = 0.35, gap: float = 3.0) -> DataFrame:
    """``line_boxes`` of ``group_lines``, made where a page's boxes are."""

    def rows_of(line: list) -> Iterable[tuple]:
        return ((*line[:4], ",".join(map(str, sorted(b[2] for b in line[5])))),)

    return _by_page(boxes, overlap, gap, rows_of, pa.schema([*_PLACE, *_CORNERS, ("ids", pa.string())]))


def line_boxes(grouped: DataFrame) -> DataFrame:
    """The union box of each line and its boxes' ids."""
    return grouped.groupBy("page", "line").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


def page_stats(lines: DataFrame) -> DataFrame:
    """Accepted lines, lines by engine, and means over the accepted ones (0 if none)."""
    ok = F.col("engine") != "uncertain"
    return lines.groupBy("page").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(ok).alias("n_accepted"),
        F.count_if(~ok).alias("n_uncertain"),
        F.count_if(F.col("engine") == "tesseract").alias("n_tesseract"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.avg(F.when(ok, F.col("quality"))), F.lit(0.0)).alias("mean_quality"),
    )


LINE = "struct<line_id:bigint,engine:string,language:string,text:string,confidence:double,quality:double>"
COUNTS = ("raw_detection_count", "usable_detection_count", "merged_line_count")
PAGE_RESULT = (
    f"source string, text string, lines array<{LINE}>, raw_detection_count long, usable_detection_count long, merged_line_count long, ocr_line_count long, accepted_line_count long, "
    "paddle_selected long, tesseract_selected long, uncertain_line_count long, average_confidence double, average_quality double"
)


def detection_counts(pages: DataFrame) -> DataFrame:
    """(page, raw, usable and merged counts) of the boxes of pages: found, large enough, and lines made of them."""
    raw = pages.select("page", F.coalesce(F.array_size("boxes"), F.lit(0)).cast("long").alias(COUNTS[0]))
    usable = clean_boxes(pages)
    kept = usable.groupBy("page").agg(F.count(F.lit(1)).alias(COUNTS[1]))
    merged = group_lines(usable).groupBy("page").agg(F.count_distinct("line").alias(COUNTS[2]))
    met = raw.join(kept, "page", "left").join(merged, "page", "left")
    return met.select("page", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def page_results(lines: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """A row for each page (source) of selected lines: its text, its lines in order, how many were
    accepted, by which engine, and means over the accepted ones (0 if none).

    ``counts`` (source and the three detection counts) is joined where it is known.
    """
    ok = F.col("engine") != "uncertain"
    fields = [f.split(":")[0] for f in LINE[7:-1].split(",")]
    ordered = F.sort_array(F.collect_list(F.struct(*fields)))
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))
    rows = lines.groupBy("source").agg(
        ordered.alias("lines"), F.count(F.lit(1)).alias("ocr_line_count"), F.count_if(ok).alias("accepted_line_count"), F.count_if(F.col("engine") == "paddle").alias("paddle_selected"),
        F.count_if(F.col("engine") == "tesseract").alias("tesseract_selected"), F.count_if(~ok).alias("uncertain_line_count"), mean("confidence").alias("average_confidence"), mean("quality").alias("average_quality"),
    )
    text = F.array_join(F.transform(F.filter("lines", lambda x: x["text"] != ""), lambda x: x["text"]), "\n")
    rows = rows.withColumn("text", text)
    rows = rows.join(counts, "source", "left") if counts is not None else rows.withColumns({c: F.lit(None).cast("long") for c in COUNTS})
    return rows.select(*[f.split()[0] for f in PAGE_RESULT.replace(LINE, "x").split(", ")])


def crop_box(boxes: DataFrame, pad: int = 12) -> DataFrame:
    """Boxes padded and clamped to (width, height) of their page."""
    return boxes.select("*", F.greatest(F.lit(0), F.col("x1") - pad).alias("cx1"), F.greatest(F.lit(0), F.col("y1") - pad).alias("cy1"), F.least(F.col("width"), F.col("x2") + pad).alias("cx2"), F.least(F.col("height"), F.col("y2") + pad).alias("cy2"))

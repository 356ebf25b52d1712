"""Evidence blocks, citations, answers and document comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..sources.store import prefix_sums, written
from . import models

SOURCE_CHARS, CHUNK_CHARS, DOCUMENT_CHARS, VISUAL_CHARS = 1800, 1400, 4500, 1600
NOTHING = "The search found no text that bears on this question."
NO_TEXT = "No text chunk of this document is long enough to quote."
NO_IMAGE = "Nothing was read from the images of this document."

Answerer = Callable[[str, str], str]


def _joined(rows: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda r: r["part"]), separator)


# The labels of evidence blocks here and below, which citations refer to.
def evidence_context(results: DataFrame) -> DataFrame:
    """(q_id, context): the retrieved chunks as numbered blocks in rank order."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
    part = F.concat(
        F.lit("\n[Source "), F.col("rank").cast("string"), F.lit("]\nFile: "), known("source"), F.lit("\nPage: "), known("page"), F.lit("\nChunk: "), known("chunk_id"),
        F.lit("\nRegion: "), known("region"), F.lit("\nContent type: "), F.coalesce("content_type", F.lit("text")), F.lit("\nEvidence:\n"), F.left(F.coalesce("text", F.lit("")), F.lit(SOURCE_CHARS)), F.lit("\n"),
    )
    return results.groupBy("q_id").agg(_joined(F.struct("rank", part.alias("part")), "\n").alias("context"))


def visual_context(analyses: DataFrame) -> DataFrame:
    """(q_id, context): what was seen on each page image, by its number."""
    part = F.concat(
        F.lit("\n[Visual Source "), F.col("number").cast("string"), F.lit("]\nPage: "), F.col("page").cast("string"), F.lit("\nFile: "), F.coalesce("source", F.lit("Unknown")),
        F.lit("\nChunk: "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("Unknown")), F.lit("\nVisual findings:\n"), F.col("analysis"), F.lit("\n"),
    )
    return analyses.groupBy("q_id").agg(_joined(F.struct("number", part.alias("part")), "\n").alias("visual"))


def citations(answer: Column, n: Column, visual: bool = False) -> Column:
    """Valid source numbers cited in an answer, sorted and distinct."""
    pattern = r"(?i)\[Visual Source\s+(\d+)\]" if visual else r"(?i)\[Source\s+(\d+)\]"
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n))))


def repair_citations(answers: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, answer, n_sources) -> answer with citations: none valid means the first two are appended."""
    found = citations(F.col("answer"), F.col("n_sources"))
    count = F.least(F.lit(2), F.col("n_sources"))
    first = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    tail = F.concat(F.lit("\n\n"), F.array_join(F.transform(first, lambda i: F.concat(F.lit("[Source "), i.cast("string"), F.lit("]"))), ""))
    df = answers.withColumn("_c", found)
    return df.select("q_id", F.when((F.size("_c") == 0) & (count > 0), F.concat("answer", tail)).otherwise(F.col("answer")).alias("answer"), F.when(F.size("_c") == 0, first).otherwise(F.col("_c")).alias("cited"), *carry)


def repair_visual(answers: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, answer, numbers) -> answer and cited_visual; an answer that cites no image gets the first.

    ``numbers`` are those of the images that could be read; they may have gaps,
    and citations are matched by number.
    """
    cited = F.array_intersect(citations(F.col("answer"), F.array_max("numbers"), visual=True), "numbers")
    df = answers.withColumn("_c", F.coalesce(cited, F.array().cast("array<int>"))).withColumn("_first", F.array_min("numbers"))
    none = (F.size("_c") == 0) & F.col("_first").isNotNull()
    return df.select("q_id", F.when(none, F.concat("answer", F.lit("\n\n[Visual Source "), F.col("_first").cast("string"), F.lit("]"))).otherwise(F.col("answer")).alias("answer"), F.when(none, F.array("_first")).otherwise(F.col("_c")).alias("cited_visual"), *carry)


def first_sentence_answerer(question: str, context: str) -> str:
    """A deterministic stand-in for a language model: the first evidence line."""
    lines = context.split("Evidence:\n", 1)
    return (lines[1].strip().split("\n", 1)[0] + " [Source 1]") if len(lines) > 1 else "No evidence."


FAILED = "The answer could not be generated."
NO_ANSWER = "Nothing relevant was found in the documents. Please rephrase the question."


def answer_questions(questions: DataFrame, results: DataFrame, answerer: Answerer = first_sentence_answerer) -> DataFrame:
    """(q_id, answer, cited, spoken, error) of the text route; questions without results get a fixed answer.

    ``spoken`` is the answer before citations were appended, as memory keeps it;
    it is empty, and nothing is cited, where the model failed (``error`` says why).
    """
    counted = results.groupBy("q_id").agg(F.count(F.lit(1)).cast("int").alias("n_sources"))
    df = questions.join(evidence_context(results), "q_id", "left").join(counted, "q_id", "left")
    said = models.ask(df, ["question", "context"], answerer, F.col("context").isNotNull())
    said = said.select("q_id", _worded(F.col("context").isNull()).alias("answer"), _sources().alias("n_sources"), _spoken(F.col("context").isNull()).alias("spoken"), "error")
    return repair_citations(said, ("spoken", "error"))


def _worded(nothing: Column) -> Column:
    """What a reader gets: the answer, or a fixed text where nothing was found or the model failed."""
    return F.when(nothing, NO_ANSWER).when(F.col("error").isNotNull(), FAILED).otherwise(F.coalesce("answer", F.lit("")))


def _spoken(nothing: Column) -> Column:
    return F.when(nothing, NO_ANSWER).otherwise(F.coalesce("answer", F.lit("")))


def _sources() -> Column:
    """Sources that an answer may cite: none where the model failed."""
    return F.when(F.col("error").isNull(), F.coalesce("n_sources", F.lit(0))).otherwise(0)


def answer_with_images(questions: DataFrame, results: DataFrame, analyses: DataFrame, fusion: bool, answerer: Answerer = first_sentence_answerer) -> DataFrame:
    """(q_id, answer, cited, cited_visual, spoken, error) of the visual route or, with ``fusion``, the fused one.

    The fused route repairs text and image citations, and falls back to the
    text route's answer where no image could be read; the visual route repairs
    image citations alone.
    """
    counted = results.groupBy("q_id").agg(F.count(F.lit(1)).cast("int").alias("n_sources"))
    seen = analyses.groupBy("q_id").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    df = questions.join(evidence_context(results), "q_id", "left").join(visual_context(analyses), "q_id", "left").join(counted, "q_id", "left").join(seen, "q_id", "left")
    both = F.concat_ws("\n", F.coalesce("context", F.lit(NOTHING)), "visual")
    nothing = F.col("context").isNull() & F.col("visual").isNull()
    df = models.ask(df.withColumn("_both", both), ["question", "_both"], answerer, ~nothing)
    seen_numbers = F.when(F.col("error").isNull(), F.col("numbers"))
    df = df.select("q_id", _worded(nothing).alias("answer"), _sources().alias("n_sources"), F.coalesce(seen_numbers, F.array().cast("array<int>")).alias("numbers"), _spoken(nothing).alias("spoken"), "error")
    df = df.withColumn("cited", citations(F.col("answer"), F.col("n_sources")))
    text = repair_citations(df, ("spoken", "error", "numbers")) if fusion else df
    return repair_visual(text, ("cited", "spoken", "error"))


def api_sources(results: DataFrame) -> DataFrame:
    """The eight fields that a client sees of every source."""
    return results.select("q_id", "rank", "page", "chunk_id", "section", "subsection", "region", F.col("final_score").alias("score"), "source", F.col("source").alias("document"))


def doc_sources(chunks: DataFrame) -> DataFrame:
    """Distinct sources in the order of their first chunk."""
    return chunks.filter(F.coalesce("source", F.lit("")) != "").groupBy("source").agg(F.min("chunk_id").alias("first_chunk"))


def doc_evidence(chunks: DataFrame, most: int = 4, least_chars: int = 80) -> DataFrame:
    """The longest text chunks of every source; ties to the earlier chunk."""
    df = chunks.filter("content_type = 'text'").withColumn("text", strip(F.coalesce("text", F.lit("")))).withColumn("_n", F.length("text")).filter(F.col("_n") >= least_chars)
    w = Window.partitionBy("source").orderBy(F.desc("_n"), "chunk_id")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("source", "place", "page", "chunk_id", "text")


def doc_compare_context(chunks: DataFrame, visual: DataFrame | None = None) -> DataFrame:
    """(number, source, text, visual): what a comparison of all documents reads of each."""
    part = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" (Chunk "), F.col("chunk_id").cast("string"), F.lit("):\n"), F.left("text", F.lit(CHUNK_CHARS)))
    texts = doc_evidence(chunks).groupBy("source").agg(F.left(_joined(F.struct("place", part.alias("part")), "\n\n"), F.lit(DOCUMENT_CHARS)).alias("text"))
    df = doc_sources(chunks).join(texts, "source", "left")
    df = df.join(visual, "source", "left") if visual is not None else df.withColumn("visual", F.lit(None).cast("string"))
    df = prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), ["first_chunk", "source"], "_one", "_before")
    return df.select(
        (F.col("_before") + 1).cast("int").alias("number"), "source",
        F.coalesce("text", F.lit(NO_TEXT)).alias("text"),
        F.coalesce(F.left("visual", F.lit(VISUAL_CHARS)), F.lit(NO_IMAGE)).alias("visual"),
    )


#: Documents, or answers about documents, that one prompt compares.
MOST_COMPARED = 20


def compare_documents(questions: DataFrame, documents: DataFrame, answerer: Answerer = first_sentence_answerer, most: int = MOST_COMPARED) -> DataFrame:
    """(q_id, answer, spoken, error): all ``documents`` of :func:`doc_compare_context` compared for each question.

    Up to ``most`` documents are one prompt.  More are compared in groups of ``most``,
    then the answers about the groups likewise, until one is left, so prompts stay of
    one size and no task holds all documents.  A group whose call failed takes part with
    a note; ``error`` is that of the last call.  ``questions`` are a block.
    """
    block = F.concat(F.lit("[Document "), F.col("number").cast("string"), F.lit("]\nFile: "), "source", F.lit("\nEvidence:\n"), "text", F.lit("\nVisual evidence:\n"), "visual")
    rows = documents.select(F.col("number").cast("long").alias("at"), block.alias("part"))
    groups = rows.groupBy(F.expr(f"(at - 1) div {most}").alias("group")).agg(_joined(F.struct("at", "part"), "\n").alias("context"))
    groups = written(groups, "compared")
    left = groups.count()
    asked = groups.crossJoin(F.broadcast(questions.select("q_id", "question")))  # every question is about all groups
    while True:
        said = models.ask(asked, ["question", "context"], answerer)
        if left <= 1:
            spoken = F.coalesce("answer", F.lit(""))
            return said.select("q_id", F.when(F.col("error").isNull(), spoken).otherwise(FAILED).alias("answer"), spoken.alias("spoken"), "error")
        said = written(said.select("q_id", "question", "group", F.coalesce("answer", F.lit(FAILED)).alias("answer")), "compared")
        part = F.concat(F.lit("[Part "), (F.col("group") + 1).cast("string"), F.lit("]\nEvidence:\n"), "answer")
        asked = said.select("q_id", "question", "group", part.alias("part")).groupBy("q_id", "question", F.expr(f"group div {most}").alias("next")).agg(_joined(F.struct("group", "part"), "\n").alias("context"))
        asked, left = asked.withColumnRenamed("next", "group"), -(-left // most)

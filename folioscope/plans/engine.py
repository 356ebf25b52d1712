"""The two life cycles as plans: from files to an index, from questions to answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons, routing
from ..operators import chunking, embedding, evidence, memory, models, retrieval, visual
from ..sources.pages import read_elements
from .versions import open_latest, write_version


def ingest(spark: SparkSession, elements_path: str, index_path: str, encoder: embedding.Encoder = embedding.hashing_encoder) -> int:
    """Page elements -> chunks -> vectors and indexes, as a new version below ``index_path``; unsound ones raise."""
    return write_version(chunking.page_chunks(read_elements(spark, elements_path)), index_path, encoder)


class Engine:
    """An opened index: ``search`` and ``answer`` take batches of questions (q_id, question).

    It reads the version that was the latest when it was opened or last reloaded.
    """

    def __init__(self, spark: SparkSession, index_path: str, encoder: embedding.Encoder = embedding.hashing_encoder, pack: lexicons.DomainPack = lexicons.NO_PACK):
        self.spark, self.path, self.encoder, self.pack = spark, index_path, encoder, pack
        self.reload()

    def reload(self) -> None:
        self.version = open_latest(self.spark, self.path)
        self.chunks, self.vectors = self.version.chunks, self.version.vectors

    def sources(self) -> DataFrame:
        return evidence.doc_sources(self.chunks)

    def without(self, source: str) -> tuple[DataFrame, DataFrame]:
        """Chunks and vectors with one document taken out."""
        kept = self.chunks.filter(~F.col("source").eqNullSafe(source))
        return kept, self.vectors.join(self.chunks.filter(F.col("source") == source).select("chunk_id"), "chunk_id", "left_anti")

    def delete(self, source: str) -> None:
        """A new version without a document."""
        kept, vectors = self.without(source)
        write_version(kept, self.path, self.encoder, vectors)
        self.reload()

    def upload(self, elements_path: str, begin: Callable[[str], None] = lambda step: None) -> None:
        """A new version with more page elements; a document that comes again replaces the one
        of its name.  Chunk ids follow the last one that this version knows; ``begin``
        is told the steps."""
        first = self.chunks.agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0))).first()[0]
        chunks = chunking.page_chunks(read_elements(self.spark, elements_path)).withColumn("chunk_id", F.col("chunk_id") + first)
        again = chunks.select("source").distinct().withColumnRenamed("source", "_again")
        kept = self.chunks.join(again, self.chunks["source"].eqNullSafe(again["_again"]), "left_anti")
        write_version(kept.unionByName(chunks, allowMissingColumns=True), self.path, self.encoder, self.vectors, begin)
        self.reload()

    def search(self, questions: DataFrame, k: int = 5) -> DataFrame:
        asked = questions.filter(F.trim("question") != "").withColumn("_x", routing.expand(F.col("question"), self.pack))
        asked = asked.join(self._encoded(asked, "_x"), "q_id").drop("_x")
        return retrieval.hybrid_search(self.chunks, self.vectors, asked, k, self.pack, self.version.postings)

    def dense(self, questions: DataFrame, k: int = 5, floor: float = 0.15) -> DataFrame:
        """Vector-only retrieval; the question is encoded with the retrieval prefix."""
        vectors = self._encoded(questions.filter(F.trim("question") != ""), "question", embedding.QUERY_PREFIX)
        return retrieval.dense_retrieve(self.chunks, self.vectors, vectors, k, floor, self.version.cells)

    def _encoded(self, questions: DataFrame, text: str, prefix: str = "") -> DataFrame:
        rows = questions.select(F.col("q_id").alias("chunk_id"), F.col(text).alias("text"), F.lit("text").alias("content_type"))
        return embedding.encode(rows, self.encoder, prefix=prefix).withColumnRenamed("chunk_id", "q_id")

    def answer(
        self,
        questions: DataFrame,
        turns: DataFrame | None = None,
        answerer: evidence.Answerer = evidence.first_sentence_answerer,
        analyser: visual.Analyser | None = None,
    ) -> DataFrame:
        """(q_id, route, answer, cited, cited_visual, spoken, error) by each question's route.

        ``turns`` (conv_id, turn, question, answer) gives memory by
        conversation; without an ``analyser`` images are not looked at.
        Comparisons of documents read the longest chunks of every document.
        """
        asked = questions
        if turns is not None:
            asked = memory.contextual_query(questions, memory.memory_context(turns)).join(questions.select("q_id", "conv_id"), "conv_id").select("q_id", F.col("query").alias("question"))
        routed = questions.select("q_id", "question", routing.route(F.col("question")).alias("route"))
        found = self.search(asked.select("q_id", "question"))
        empty = F.array().cast("array<int>")
        text = routed.filter(F.col("route") == "text") if analyser else routed.filter(F.col("route") != "comparison")
        said = evidence.answer_questions(text, found.join(text.select("q_id"), "q_id", "left_semi"), answerer).withColumn("cited_visual", empty)
        if analyser:
            pages = visual.select_pages(routed, found, visual.available_pages(self.chunks), visual.table_pages(self.chunks))
            seen = visual.analyze_pages(pages, routed.select("q_id", "question"), analyser)
            for fusion, routes in ((False, ("visual", "table")), (True, ("fusion",))):
                part = routed.filter(F.col("route").isin(*routes))
                keep = lambda df, p=part: df.join(p.select("q_id"), "q_id", "left_semi")
                near = keep(found) if fusion else keep(found).filter("rank <= 2")
                said = said.unionByName(evidence.answer_with_images(part, near, keep(seen), fusion, answerer))
        compared = routed.filter(F.col("route") == "comparison")
        if compared.isEmpty():
            return said.join(routed.select("q_id", "route"), "q_id")
        documents = evidence.doc_compare_context(self.chunks, self._looked_at(analyser) if analyser else None)
        compared = retrieval.in_blocks(compared, lambda block: evidence.compare_documents(block, documents, answerer))
        compared = compared.select("q_id", "answer", empty.alias("cited"), empty.alias("cited_visual"), "spoken", "error")
        said = said.unionByName(compared)
        return said.join(routed.select("q_id", "route"), "q_id")

    def _looked_at(self, analyser: visual.Analyser) -> DataFrame:
        """(source, visual): what the analyser sees on the first page image of every document."""
        pages = visual.available_pages(self.chunks)
        first = pages.groupBy("source").agg(F.min(F.struct("page", "chunk_id", "path")).alias("p"))
        asked = first.select("source", F.lit("What does this page show?").alias("_prompt"), F.col("p.path").alias("path"))
        return models.ask(asked, ["_prompt", "path"], analyser, answer="visual").select("source", "visual")

    @staticmethod
    def remember(turns: DataFrame, questions: DataFrame, answered: DataFrame) -> DataFrame:
        """``turns`` (conv_id, turn, question, answer) with those of a batch of answers after them.

        Memory keeps an answer as it was before citations were appended.
        """
        last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
        said = questions.select("q_id", "conv_id", "question").join(answered.select("q_id", F.col("spoken").alias("answer")), "q_id").join(last, "conv_id", "left")
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("q_id"))
        new = said.select("conv_id", (F.coalesce("_last", F.lit(-1)) + place).cast(turns.schema["turn"].dataType).alias("turn"), "question", "answer")
        return turns.select("conv_id", "turn", "question", "answer").unionByName(new)

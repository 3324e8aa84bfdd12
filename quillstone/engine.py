"""One entrance: retrieve evidence for a table of questions, answer them, check the citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import evidence as E
from quillstone.operators.retrieval import Retriever
from quillstone.session import materialize


class Engine:
    """A retriever with an answering column function ``answerer(question, context)``; the model behind it is the caller's."""

    def __init__(self, chunks: DataFrame, answerer: Callable[[Column, Column], Column], **limits):
        """``chunks``: (chunk_id, text, embedding) and, where known, document_id and page; ``limits`` as ``Retriever`` has them."""
        self.chunks, self.answerer, self.retriever = chunks, answerer, Retriever(chunks, **limits)

    def retrieve(self, questions: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
        """The selected chunks of every question (query_id, question, qvec)."""
        return self.retriever.retrieve(questions, exclude)

    def ask(self, questions: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
        """(query_id, question, context, answer, labels, unknown, status): one retrieval and one answer a question.

        ``status``: no_evidence (then there is no answer), uncited, invalid (a cited
        label isn't in the context) or valid.  Labels are checked, facts aren't.
        """
        picked = self.retrieve(questions, exclude).select(F.col("query_id").alias("session"), "chunk_id", "rank", F.lit(1).alias("round"))
        where = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in self.chunks.columns else F.lit("") for c in ("document_id", "page")]
        told = self.chunks.select("chunk_id", where[0].alias("document"), F.when(where[1] != "", F.concat(F.lit("page "), where[1])).otherwise("").alias("location"), F.coalesce("text", F.lit("")).alias("text"))
        book = materialize(E.register(picked), "evidence")
        contexts = E.context(book.join(told, "chunk_id"))
        q = questions.select(F.col("query_id").alias("session"), "question").join(contexts, "session", "left")
        # written once, so a model is asked once
        said = materialize(q.withColumn("answer", F.when(F.col("context").isNotNull(), self.answerer(F.col("question"), F.col("context")))), "answers")
        given = said.where("answer is not null").select("session", "answer")
        cited = E.check_citations(given, book)
        status = E.citation_status(given, cited)
        lists = cited.groupBy("session").agg(*(F.transform(F.sort_array(F.collect_list(F.when(ok, F.struct("use_no", "label")))), lambda x: x["label"]).alias(n) for n, ok in (("labels", F.col("known")), ("unknown", ~F.col("known")))))
        none = F.expr("cast(array() as array<string>)")
        out = said.join(status, "session", "left").join(lists, "session", "left")
        return out.select(F.col("session").alias("query_id"), "question", "context", "answer", F.coalesce("labels", none).alias("labels"), F.coalesce("unknown", none).alias("unknown"), F.coalesce("status", F.lit("no_evidence")).alias("status"))

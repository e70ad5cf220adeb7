"""A question file evaluated in bulk: search for all questions at once, hits, gate, and answers if asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.providers import Provider
from lexmill.operators import evaluation
from lexmill.operators.answering import answer, embed
from lexmill.params import DEFAULT, Params
from lexmill.plans import search
from lexmill.sources.tables import materialize


def evaluated(spark: SparkSession, data: str, questions: DataFrame, provider: Callable[[], Provider], p: Params = DEFAULT, vectors: str = "", answers: bool = False) -> DataFrame:
    """A row a question of questions(id, question, kind, expected): what was retrieved, the first hit, the gate's verdict, and
    with ``answers`` the answer, its citations and flags, how long it took, or the error of that one question.

    kind out_of_scope marks questions that should be refused; any other, or none, is answerable. Null questions find nothing.
    """
    asked = questions.select(F.monotonically_increasing_id().alias("qid"), "id", F.coalesce("question", F.lit("")).alias("text"), "kind", F.coalesce("expected", F.array().cast("array<string>")).alias("expected"))
    asked = materialize(asked, "questions")
    docs = search.corpus(spark, data)
    rows, own = search.embedded(spark, data, provider, vectors), materialize(embed(asked, F.col("text"), provider, "qid"), "question-vectors")
    found = materialize(search.fused(spark, data, docs, asked, rows, own, p), "results")
    named = found.join(docs.select("doc_id", "article_no", "label"), "doc_id").join(asked.select("qid", "expected"), "qid")
    hits = evaluation.first_hits(named, F.array_contains("expected", F.col("article_no")), asked)
    shown = named.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_no"))), lambda x: x["article_no"]).alias("retrieved"), F.max("relevant").alias("relevant"), F.max("max_sim").alias("max_sim"), F.count_if("in_context").alias("context_count"))  # top_k rows a question
    out = hits.join(shown, "qid", "left").withColumns({"answerable": F.coalesce(F.col("kind") != "out_of_scope", F.lit(True)), "relevant": F.coalesce("relevant", F.lit(False))})
    if not answers:
        return out
    said = answer(asked, found, docs, provider, p).select("qid", "answer", "citations", "unsupported", "unknown", "trusted", "auto_cited", "error", "generation_ms")
    out = out.join(said, "qid")
    cited = F.exists("citations", lambda c: F.exists("expected", lambda e: F.endswith(F.upper(c), F.concat(F.lit(" M. "), F.upper(e)))))
    out = out.withColumns({"cited_expected": F.when(F.col("answerable"), cited), "refused": F.when(~F.col("answerable"), F.col("unknown"))})
    good = F.when(F.col("answerable"), F.col("cited_expected") & (F.size("unsupported") == 0)).otherwise(F.col("refused"))
    return out.withColumn("success", F.when(F.col("error") == "", good))

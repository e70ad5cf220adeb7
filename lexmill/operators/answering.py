"""Questions to checked answers: context, messages, a model in Arrow batches, clean-up, citations, safety net, flags."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import answers, text
from lexmill.functions.providers import Provider, ask
from lexmill.params import DEFAULT, Params
from lexmill.sources.tables import arrow_map

_MESSAGES = "array<struct<role:string,content:string>>"


def embed(rows: DataFrame, column: Column, provider: Callable[[], Provider], id_col: str, batch: int = 16) -> DataFrame:
    """(id, vec): embeddings in batches; the provider is made once a task. A wrong count of vectors raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = provider()
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                vectors = model.embed([t or "" for t in part.column(1).to_pylist()])
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], [id_col, "vec"])

    return rows.select(F.col(id_col).cast("long"), column.cast("string")).transform(arrow_map, run, f"{id_col} long, vec array<float>")


def generate(prompts: DataFrame, provider: Callable[[], Provider], p: Params = DEFAULT) -> DataFrame:
    """prompts(qid, messages) with the model's raw answer, how long it took, or the error of that one question; the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = provider()
        for b in batches:
            said, failed, took = [], [], []
            for messages in b.column(1).to_pylist():
                began = time.monotonic()
                try:
                    said.append(ask(model, messages or [], p))
                    failed.append("")
                except (OSError, RuntimeError, ValueError) as e:
                    said.append("")
                    failed.append(str(e) or type(e).__name__)
                took.append(1000 * (time.monotonic() - began))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array(failed, pa.string()), pa.array(took, pa.float64())], ["qid", "raw", "error", "generation_ms"])

    return prompts.select(F.col("qid").cast("long"), F.col("messages").cast(_MESSAGES)).transform(arrow_map, run, "qid long, raw string, error string, generation_ms double")


def finish(raw: DataFrame) -> DataFrame:
    """raw(qid, raw, shown labels, in_scope) with the final answer, its citations, unsupported ones and flags."""
    cleaned = answers.clean_answer(text.strip_think(F.col("raw")))
    out = raw.withColumn("clean", cleaned).withColumn("own", answers.extract_citations(F.col("clean")))
    out = out.withColumn("answer", answers.safety_net(F.col("clean"), F.col("own"), F.col("shown"), F.col("in_scope")))
    # labels of provisions outside the law don't have the form of a citation: they count where they stand as shown
    outside = F.filter("shown", lambda s: F.contains(s, F.lit("işlenemeyen hüküm")) & F.contains(F.col("answer"), F.concat(F.lit("["), s, F.lit("]"))))
    out = out.withColumns({"citations": F.array_union(answers.extract_citations(F.col("answer")), outside), "unknown": answers.is_unknown(F.col("answer")), "auto_cited": F.col("answer") != F.col("clean")})
    bare = F.transform("shown", lambda s: F.upper(F.regexp_replace(s, r" \(\d+/\d+\)$", "")))
    cited = F.transform("citations", lambda c: F.upper(c))
    out = out.withColumn("unsupported", F.array_except(cited, bare))
    return out.withColumn("trusted", answers.is_trusted(F.col("citations"), F.col("unsupported"), F.col("unknown"), F.col("in_scope"))).drop("clean", "own")


def answer(questions: DataFrame, results: DataFrame, corpus: DataFrame, provider: Callable[[], Provider], p: Params = DEFAULT) -> DataFrame:
    """questions(qid, text) with results of plans.search.hybrid answered over corpus(doc_id, label, heading, content)."""
    shown = results.where("in_context").join(corpus, "doc_id")
    block = answers.context_block(F.col("label"), F.col("heading"), F.lit(""), F.col("content"))
    each = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), "label", "heading"))).alias("c"), F.max("relevant").alias("relevant"))
    none = F.array().cast("array<string>")
    rows = questions.join(each, "qid", "left").select(
        "qid", "text", F.coalesce(F.transform("c", lambda x: x["block"]), none).alias("blocks"), F.coalesce(F.transform("c", lambda x: x["label"]), none).alias("shown"),
        F.coalesce(answers.source_list(F.transform("c", lambda x: x["label"]), F.transform("c", lambda x: x["heading"])), none).alias("sources"), F.coalesce("relevant", F.lit(False)).alias("in_scope"),
    )
    prompts = rows.withColumn("messages", answers.add_suffix(answers.build_messages(F.col("text"), F.col("blocks"), F.col("in_scope"))))
    made = generate(prompts, provider, p)
    return finish(made.join(rows.select("qid", "shown", "sources", "in_scope"), "qid"))

"""Command line: ask, search, article, chat, diagnose, health, evaluate, ingest. Example: python -m lexmill.cli --data DIR search "question"."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.providers import Provider, choose
from lexmill.operators import evaluation
from lexmill.operators.answering import answer, embed
from lexmill.params import Params
from lexmill.plans import search
from lexmill.plans.evaluate import evaluated
from lexmill.session import local_session
from lexmill.sources.store import read_questions, write_report
from lexmill.sources.tables import materialize
from lexmill.streaming.ingest import ingest_stream

LEAVE = {"exit", "quit", "q", "çık", "cik", "kapat"}


def provider_of(names: str, url: str, chat_model: str = "", embed_model: str = "") -> Callable[[], Provider]:
    """The first usable provider of a comma-separated list; made anew in every task."""
    known = {"dev": {}, "http": {"base": url, "chat_model": chat_model, "embed_model": embed_model}}
    return partial(choose, [(n, known.get(n, {})) for n in names.split(",")])


def find(spark: SparkSession, data: str, question: str, p: Params, provider: Callable[[], Provider], vectors: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Question, corpus and the top results of all three channels, with the gate's verdict and marks for context."""
    docs, asked = search.corpus(spark, data), spark.createDataFrame([(0, question)], "qid long, text string")
    rows = search.embedded(spark, data, provider, vectors)
    own = materialize(embed(asked, F.col("text"), provider, "qid"), "question")
    return asked, docs, materialize(search.fused(spark, data, docs, asked, rows, own, p), "results")


def show(results: DataFrame, docs: DataFrame, long: bool) -> None:
    for r in results.join(docs, "doc_id").orderBy("rank").collect():  # top_k rows
        print(f"{r['rank']}. [{r.label}] {r.heading}  ({r.score:.4f}; {', '.join(r.sources)}){'' if r.in_context else '  not in context'}")
        print("   " + (r.content if long else r.content[:200].replace("\n", " ")))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexmill")
    parser.add_argument("--data", required=True, help="folder of the tables")
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--long", action="store_true", help="whole texts")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("ask", "search", "article"):
        sub.add_parser(name).add_argument("text")
    for name in ("chat", "diagnose", "health"):
        sub.add_parser(name)
    judge = sub.add_parser("evaluate")
    judge.add_argument("questions", help="JSON file of questions")
    judge.add_argument("out", help="folder of the report")
    judge.add_argument("--answers", action="store_true", help="answer them too")
    ingest = sub.add_parser("ingest")
    ingest.add_argument("out")
    ingest.add_argument("checkpoint")
    parser.add_argument("--provider", default="dev", help="providers by name, the first usable one is taken: dev, http")
    parser.add_argument("--url", default="http://127.0.0.1:5273", help="local server of the http provider")
    parser.add_argument("--chat-model", default="")
    parser.add_argument("--embed-model", default="")
    parser.add_argument("--vectors", default="", help="folder of the corpus's embeddings, written if it isn't there; without it they are made anew")
    args = parser.parse_args(argv)
    provider = provider_of(args.provider, args.url, args.chat_model, args.embed_model)
    spark = SparkSession.getActiveSession() or local_session()
    p = Params(top_k=args.top_k)

    def reply(question: str) -> None:
        asked, docs, results = find(spark, args.data, question, p, provider, args.vectors)
        r = answer(asked, results, docs, provider, p).first()
        print(r.error or r.answer)
        print("sources: " + "; ".join(r.sources))
        if not r.in_scope:
            print("out of scope: nothing in the corpus is near enough")
        print("checked" if r.trusted else "NOT SUPPORTED by what was shown: " + (", ".join(r.unsupported) or "no citation"))

    if args.command == "ask":
        reply(args.text)
    elif args.command == "search":
        _, docs, results = find(spark, args.data, args.text, p, provider, args.vectors)
        show(results, docs, args.long)
    elif args.command == "article":
        rows = search.corpus(spark, args.data).where(F.upper("article_no") == args.text.upper()).orderBy("label").collect()
        for r in rows:
            print(f"[{r.label}] {r.heading}\n{r.content}")
        return int(not rows)
    elif args.command == "chat":
        for line in sys.stdin:
            if line.strip().lower() in LEAVE:
                break
            if line.strip():
                reply(line.strip())
    elif args.command == "diagnose":
        print(provider().diagnose())
    elif args.command == "health":
        c = search.corpus(spark, args.data).withColumns({"source": F.col("law"), "topic": F.col("heading"), "part_no": F.lit(1), "parts": F.lit(1)})
        found = evaluation.integrity(c).first().asDict()
        print("\n".join(f"{k}: {v}" for k, v in found.items()))
        return int(not found["chunks"] or bool(found["empty"]))
    elif args.command == "evaluate":
        rows = materialize(evaluated(spark, args.data, read_questions(spark, args.questions), provider, p, args.vectors, args.answers), "evaluated")
        write_report(evaluation.report(rows), rows, args.out)
        for k, v in spark.read.json(f"{args.out}/summary").first().asDict().items():
            print(f"{k}: {v}")
    elif args.command == "ingest":
        ingest_stream(spark, args.data, args.out, args.checkpoint).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())

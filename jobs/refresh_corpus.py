"""Keeps a corpus of search-ready chunks up to date with a folder of document files that grows (incremental).

    python -m jobs.refresh_corpus --documents DATA/documents --out CORPUS --checkpoint MARK

documents: Parquet files (doc_id, text, source), a folder or a glob. Each run takes the files that no run has taken before:
the checkpoint knows them. A document that comes again replaces its earlier version. Every chunk has its citation label,
its text, and the normalised text that search reads; out is partitioned by batch and law. Running again without new files
writes nothing, and a run that was cut off writes its batch again in the same place.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.config import log, options
from lexmill.functions.text import normalize
from lexmill.operators.chunking import chunk, citation_label
from lexmill.params import Params
from lexmill.streaming import ingest

DOCUMENTS = "doc_id long, text string, source string"


def chunk_rows(docs: DataFrame, p: Params) -> DataFrame:
    """At least one chunk a document: a text without any is one chunk as it is, null as empty."""
    rows = docs.select("doc_id", F.upper("source").alias("law"), F.coalesce("text", F.lit("")).alias("text"), "arrived", "sha256", "place")
    parts = chunk(rows, F.split("text", "\n"), F.col("text"), p).drop("text").hint("rebalance", "law")  # a law's chunks go to few files, a large law's to several
    label = citation_label(F.coalesce("law", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("madde"), F.lit(""), F.col("part_no"), F.col("parts"))
    return parts.withColumns({"label": label, "norm": normalize(F.col("chunk"))})


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, files_a_batch: int = 1000, chunk_chars: int = 2400, chunk_overlap: int = 200) -> dict[str, int]:
    """One run over all new files, waited for. Returns how many rows were read and chunks written."""
    logger, p = log("refresh_corpus"), Params(chunk_chars=chunk_chars, chunk_overlap=chunk_overlap)
    counts = {"read": 0, "written": 0, "batches": 0}
    watched: list[tuple[int, Observation]] = []

    def told(batch_id: int, rows: DataFrame) -> DataFrame:
        seen = Observation(f"batch {batch_id}")
        watched.append((batch_id, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("chunks"))

    rows = ingest.new_files(spark, documents, DOCUMENTS, "text", files_a_batch)
    query = ingest.start(rows, lambda docs: chunk_rows(docs, p), out, checkpoint, ("law",), told)
    query.awaitTermination()
    for progress in query.recentProgress:
        counts["read"] += progress.numInputRows
    for batch_id, seen in watched:
        counts["batches"] += 1
        counts["written"] += seen.get["chunks"]
        logger.info("batch %d: %d chunks to %s", batch_id, seen.get["chunks"], out)
    logger.info("read %d documents from %s, wrote %d chunks in %d batches", counts["read"], documents, counts["written"], counts["batches"])
    return counts


def read_corpus(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of every document's last version."""
    return ingest.current(spark.read.parquet(out), "doc_id")


def main(argv: list[str] | None = None) -> int:
    given = options(__doc__.splitlines()[0], Path(__file__).with_suffix(".json"), argv, ("documents", "out", "checkpoint"))
    spark = SparkSession.builder.appName("refresh_corpus").getOrCreate()
    try:
        run(spark, **given)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

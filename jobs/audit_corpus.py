"""Checks a corpus law by law and writes what is wrong with it: empty, short and contaminated articles, repeated numbers, gaps.

    python -m jobs.audit_corpus --documents DATA/documents --out REPORT

documents: Parquet (doc_id, text, source): an article of the law ``source``. out is partitioned by check; each partition has a
row of rank 0 for every law, with the number of findings, and the first findings with their article and value. A run
replaces the partitions of the run before; so a run again, or after one that was cut off, leaves the same report.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from jobs.config import log, options
from lexmill.operators.evaluation import audit
from lexmill.sources.store import replace_sources


def run(spark: SparkSession, documents: str, out: str, short: int = 40, examples: int = 3) -> dict[str, int]:
    """Audit once. Returns how many rows were read and written, and how many findings of each faulty kind there are."""
    logger = log("audit_corpus")
    docs = spark.read.parquet(documents)
    articles = docs.select(F.upper("source").alias("law"), F.col("doc_id").alias("article_no"), F.col("text").alias("content"))
    seen = Observation("findings")
    found = audit(articles, short, examples)
    of = lambda check: F.coalesce(F.sum(F.when((F.col("rank") == 0) & (F.col("check") == check), F.col("value"))), F.lit(0)).alias(check)
    # every check has a row for every law, so no partition of an earlier run outlives this one
    replace_sources(found.observe(seen, F.count(F.lit(1)).alias("written"), of("longest").alias("read"), *[of(c) for c in ("empty", "short", "contaminated", "repeated", "gap")]).coalesce(8), out, "check")
    counts = dict(seen.get)
    logger.info("read %d articles from %s, wrote %d rows to %s", counts["read"], documents, counts["written"], out)
    for check in ("empty", "short", "contaminated", "repeated", "gap"):
        logger.info("%s: %d", check, counts[check])
    return counts


def main(argv: list[str] | None = None) -> int:
    given = options(__doc__.splitlines()[0], Path(__file__).with_suffix(".json"), argv, ("documents", "out"))
    spark = SparkSession.builder.appName("audit_corpus").getOrCreate()
    try:
        counts = run(spark, **given)
    finally:
        spark.stop()
    return int(bool(counts["empty"] or counts["contaminated"] or counts["repeated"]))


if __name__ == "__main__":
    raise SystemExit(main())

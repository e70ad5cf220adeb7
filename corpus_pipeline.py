"""The corpus pipeline: quality rules, quality classifier, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Models and counts of a stage come from its own input and the labels table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import packing, pii, quality_rules, rule_ensemble, simhash
from lexmill.llm.columns import kept_rows
from lexmill.sources.tables import materialize, read_table


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside the columns that a stage reads, so that no column of the row can clash with results."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: the base rules and the log-likelihood ratio.

    Null and empty texts fail the base rules and go. Repeated rows are judged alike, each by itself, so there are no
    ties. A null doc_id is never trusted. All columns pass, whatever their names; an empty table stays empty.
    """
    trusted = quality_rules.trusted_ids(read_table(spark, sf_dir, "labels"))
    judged = quality_rules.apply_rules(_whole(docs), quality_rules.fit_weights(docs, trusted))
    return kept_rows(judged, F.col("kept"), ["row.*"])


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below its cut go.

    Null and empty texts are scored like any. Repeated rows score alike; a score equal to the cut stays. Without labels
    of both classes all documents score alike, and without any label 0 they all stay. All columns pass, whatever their
    names; an empty table stays empty.
    """
    model = rule_ensemble.train(docs, read_table(spark, sf_dir, "labels"))
    return kept_rows(rule_ensemble.score(_whole(docs), model), F.col("predicted") == 1, ["row.*"])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id.

    Null and empty texts link with each other; texts of any length are compared whole. Rows that repeat a document go but for one; unlike texts under one id are documents of their own; rows without an
    id stay only where no row of their group has one. All columns pass, whatever their names; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text.

    Null texts stay null, and so does their n_chars; empty ones have no span. Overlapping spans are masked as one; repeated rows are masked alike; an empty table stays empty.
    """
    seen = materialize(pii.scan(docs), "pii")
    out = pii.mask(seen, pii.fit(seen))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows, with little memory beside what the earlier stages' workers hold.

    A null or empty text is its end id alone; a long one spans many windows. Repeated rows are packed as often as they
    occur; a null doc_id stays null. Other columns, whatever their names, don't matter; an empty table gives no rows.
    """
    return packing.pack(docs, cache_runs=60_000, batch_bytes=1 << 20)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("SimHash near-dedup", near_duplicates_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]
#: The models and fingerprints can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs

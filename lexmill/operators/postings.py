"""A stored word index: postings and vocabulary as Parquet, written once and read by every search.

postings(part, token, doc_id, tf, n_tokens): partitioned by a hash of the token, each file sorted by token. A search for few
words opens the folders of their parts only, and in them the row groups that may hold them. vocabulary(token, df, part) is
sorted by token. stats has one row; it is written last, so an index without it isn't whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import lexical, ranking
from lexmill.sources.tables import arrow_map, materialize

#: Folders of the postings.
PARTS = 64
#: Asked tokens up to which a scan is told which folders and tokens to read.
FEW_TOKENS = 200


@dataclass
class Index:
    postings: DataFrame
    vocabulary: DataFrame
    n_docs: int
    average: float
    parts: int = PARTS
    unique: bool = False  # no two rows had one id


def part_of(token: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(parts)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, doc_id, tf, n_tokens) of (doc_id, normalised text), a row a word of each text."""
    for batch in batches:
        for a, b, row, code, words in ranking.word_pieces(batch):
            size = max(1, len(words))
            keys, tf = np.unique(row * size + code, return_counts=True)
            own, length = keys // size, np.bincount(row, minlength=b - a)
            token = words.take(pa.array(keys % size)).cast(pa.string())
            ids = batch.column(0).slice(a, b - a).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([token, ids, pa.array(tf.astype(np.int32)), pa.array(length[own].astype(np.int32))], ["token", "doc_id", "tf", "n_tokens"])


def write_index(docs: DataFrame, normalized: Column, path: str, id_col: str = "doc_id", parts: int = PARTS) -> None:
    """Index the words of every row under ``path``. A row without words counts among the documents; rows with one id are one document.

    Words are counted and sorted where the texts are read; no shuffle. Rows with one id stay apart in the postings, which
    term_documents puts together; the vocabulary counts their documents once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), normalized.alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = arrow_map(rows, _counted, f"token string, doc_id {id_type}, tf int, n_tokens int").withColumn("part", part_of(F.col("token"), parts))
    counted.sortWithinPartitions("part", "token", "doc_id").write.partitionBy("part").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    sizes = docs.agg(F.count_distinct(id_col).alias("n_docs"), F.count("*").alias("n_rows"))
    n_docs, n_rows = sizes.first()
    each = stored if n_docs == n_rows else stored.select("part", "token", "doc_id").distinct()
    words = each.groupBy("part", "token").agg(F.count("*").alias("df"))
    words.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/vocabulary")
    total = stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    total.select(F.lit(n_docs).alias("n_docs"), "n_tokens", F.lit(parts).alias("parts"), F.lit(n_docs == n_rows).alias("unique")).write.parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"), r.n_docs, r.n_tokens / max(1, r.n_docs), r.parts, r.unique)


def postings_of(index: Index, met: DataFrame) -> DataFrame:
    """The postings of met(term, token), with the term. met must be a table; it is counted before it is broadcast.

    For few tokens the scan gets them as literals, and so reads only their folders and row groups.
    """
    n = met.count()
    rows = index.postings
    if n <= FEW_TOKENS:
        asked = met.select("token", part_of(F.col("token"), index.parts).alias("part")).distinct().collect()  # FEW_TOKENS rows at most
        rows = rows.where(F.col("part").isin(sorted({r.part for r in asked})) & F.col("token").isin(sorted({r.token for r in asked})))
    return rows.join(F.broadcast(met) if n <= lexical.MOST_MATCHES else met, "token")


def term_documents(index: Index, wanted: DataFrame, limits: tuple[float, ...] = ()) -> DataFrame:
    """(term, doc_id, tf, n_tokens), stored: a prefix term counts every token that it matches; n_tokens is the document's length.

    With limits (shares of all documents) only the terms that lexical.selective_terms may keep for some query under one of
    them: see needed_terms.
    """
    met = lexical.matches(index.vocabulary, wanted)
    if limits:
        known = materialize(met.join(index.vocabulary.select("token", "df"), "token"), "term-tokens")
        few = F.broadcast(needed) if (needed := materialize(needed_terms(known, wanted, index.n_docs, limits), "needed-terms")).count() <= lexical.MOST_MATCHES else needed
        met = known.drop("df").join(few, "term", "left_semi")
    found = postings_of(index, materialize(met, "term-tokens")).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.max("n_tokens").alias("n_tokens"))
    return materialize(found, "term-documents")


def document_frequency(index: Index, wanted: DataFrame) -> DataFrame:
    """(term, df), zero for terms without a document: lexical.document_frequency of all term_documents, without storing them.

    A term of one token has that token's count in the vocabulary. Only terms of several are looked up in the postings, and
    only their numbers and the documents' ids are shuffled.
    """
    met = materialize(lexical.matches(index.vocabulary, wanted).join(index.vocabulary.select("token", "df"), "token"), "term-tokens")
    of = met.groupBy("term").agg(F.count("*").alias("tokens"), F.max("df").alias("df")).withColumn("n", F.monotonically_increasing_id())
    of = materialize(of, "terms")
    several = of.where("tokens > 1").select("term", "n")
    pairs = met.join(several, "term").select(F.col("n").alias("term"), "token")
    counted = postings_of(index, materialize(pairs, "term-tokens")).select(F.col("term").alias("n"), "doc_id").distinct().groupBy("n").agg(F.count("*").alias("df"))
    found = of.where("tokens = 1").select("term", "df").unionByName(several.join(counted, "n").select("term", "df"))
    return wanted.select("term").distinct().join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def needed_terms(known: DataFrame, wanted: DataFrame, n_docs: int, limits: tuple[float, ...]) -> DataFrame:
    """The terms whose postings a search must read, from known(term, token, df).

    A term stands in at least as many documents as its most frequent token, and in at most the sum over its tokens. If that
    least is above every limit, the term is too frequent for a query that has a surely selective term under all of them; so
    its postings, the longest of all, are read only for a query without one.
    """
    low, high = (max(1, int(n_docs * x)) for x in (min(limits), max(limits)))
    bounds = known.groupBy("term").agg(F.max("df").alias("least"), F.sum("df").alias("most"))
    each = wanted.select("qid", "term").join(bounds, "term")
    sure = each.groupBy("qid").agg(F.max(F.col("most") <= low).alias("sure"))
    return each.join(sure, "qid").where((F.col("least") <= high) | ~F.col("sure")).select("term").distinct()

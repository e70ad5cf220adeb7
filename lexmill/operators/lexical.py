"""Prefix full-text search for many queries at once: matching tokens, document frequency, selective terms, BM25.

Inputs: docs(doc_id, field, ...) and queries(qid, text). Terms come from functions.text.query_terms; a term ending in *
is a prefix, any other is exact. Prefixes meet tokens by equality of the token's own prefixes, so there is no theta join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.functions.text import query_terms, words
from lexmill.params import DEFAULT, Params
from lexmill.sources.tables import materialize

#: Rows of terms, of pairs of a term and a token, or of kept terms that may be broadcast; more of them are shuffled.
MOST_MATCHES = 1_000_000
#: Beginnings of tokens are compared up to this length first. Shares of the documents that a term's rows are dealt to.
LONGEST, SHARES = 64, 64


def tokens(docs: DataFrame, normalized: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, words): one row a document."""
    return docs.select(F.col(id_col).alias("doc_id"), words(normalized).alias("words"))


def terms(queries: DataFrame, text: Column | None = None) -> DataFrame:
    """(qid, place, term): each query's terms in order."""
    return queries.select("qid", F.posexplode(query_terms(F.col("text") if text is None else text)).alias("place", "term"))


def matches(vocabulary: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, token) for every token of vocabulary(token) that a term stands for.

    Tokens meet prefix terms by equality of their own beginnings, of just the lengths that terms have.
    """
    distinct = wanted.select("term").distinct()
    keys = distinct.select("term", F.regexp_replace("term", r"\*$", "").alias("key"), F.endswith(F.col("term"), F.lit("*")).alias("prefix"))
    sizes = {r[0]: r[1] for r in keys.groupBy(F.when(F.col("prefix"), F.least(F.length("key"), F.lit(LONGEST))).otherwise(0)).count().collect()}  # LONGEST + 1 rows at most
    if sum(sizes.values()) <= MOST_MATCHES:
        keys = F.broadcast(keys)
    lengths = sorted(n for n in sizes if n)
    starts = F.filter(F.array(*[F.when(F.length("token") >= n, F.left("token", F.lit(n))) for n in lengths]) if lengths else F.array().cast("array<string>"), lambda x: x.isNotNull())
    started = vocabulary.select("token", F.explode(starts).alias("start"))
    by_prefix = started.join(keys.where("prefix").withColumn("start", F.left("key", F.lit(LONGEST))), "start").where(F.startswith("token", F.col("key"))).select("term", "token")
    exact = vocabulary.join(keys.where("not prefix"), F.col("token") == F.col("key")).select("term", "token")
    return by_prefix.unionByName(exact)


def term_documents(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, doc_id, tf, n_tokens) of rows that are in no index: a prefix term counts every token that it matches; n_tokens
    is the document's length. Only tokens that a term stands for leave the rows."""
    met = materialize(matches(tokens.select(F.explode("words").alias("token")).distinct(), wanted), "term-tokens")
    if met.count() <= MOST_MATCHES:
        met = F.broadcast(met)
    each = tokens.select("doc_id", F.size("words").alias("n_tokens"), F.explode("words").alias("token"))
    return each.join(met, "token").groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("n_tokens").alias("n_tokens"))


def document_frequency(term_docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df), zero for terms without a document."""
    found = term_docs.groupBy("term").agg(F.count("*").alias("df"))
    return wanted.select("term").distinct().join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def selective_terms(wanted: DataFrame, df: DataFrame, n_docs: int, p: Params = DEFAULT) -> DataFrame:
    """(qid, place, term, df) kept for the search: those in at most df_limit of the documents, else the rarest few."""
    limit = max(1, int(n_docs * p.df_limit))
    known = wanted.join(df, "term").where("df > 0")
    own = W.partitionBy("qid")
    flagged = known.withColumn("fits", F.col("df") <= limit).withColumn("any_fits", F.max("fits").over(own))
    ranked = flagged.withColumn("rank", F.row_number().over(own.orderBy("df", "place")))
    return ranked.where(F.when(F.col("any_fits"), F.col("fits")).otherwise(F.col("rank") <= p.rare_terms)).select("qid", "place", "term", "df")


def weight(n_docs: int) -> Column:
    """A term's weight by its column df."""
    idf = F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf)


def bm25(kept: DataFrame, term_docs: DataFrame, n_docs: int, average: float, p: Params = DEFAULT) -> DataFrame:
    """(qid, doc_id, score): the sum over a query's kept terms of idf * saturated tf."""
    norm = p.bm25_k1 * (1 - p.bm25_b + p.bm25_b * F.col("n_tokens") / F.lit(float(average)))
    scored = _with_terms(kept, term_docs)
    return scored.groupBy("qid", "doc_id").agg(F.round(F.sum(weight(n_docs) * F.col("tf") * (p.bm25_k1 + 1) / (F.col("tf") + norm)), 6).alias("score"))


def _with_terms(kept: DataFrame, term_docs: DataFrame) -> DataFrame:
    """kept(qid, term, df) joined with term_docs by term. A term may stand in a large share of all documents, so its rows are
    never dealt to one task: few kept terms are broadcast; else both sides are dealt by term and a share of the documents."""
    kept = materialize(kept, "kept-terms")
    if kept.count() <= MOST_MATCHES:
        return term_docs.join(F.broadcast(kept), "term")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))
    return term_docs.withColumn("_share", share).join(kept.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))), ["term", "_share"]).drop("_share")


def top(scored: DataFrame, k: int, score: str = "score", id_col: str = "doc_id", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k best of each query with their 1-based rank; ties by id."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)

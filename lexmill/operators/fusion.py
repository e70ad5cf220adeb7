"""Weighted reciprocal rank fusion of ranked channels, the relevance gate and the choice of context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.params import DEFAULT, Params

#: Channel order, which also breaks ties of the fused score.
CHANNELS = ("vector", "lexical", "number")


def fuse(channels: dict[str, tuple[DataFrame, float]], p: Params = DEFAULT) -> DataFrame:
    """(qid, doc_id, score, sources, tie) from channel -> (ranked rows (qid, doc_id, rank), weight).

    A weight of zero keeps the rows with nothing added. Ties: vector order, then lexical, then number order.
    """
    parts = None
    for name, (rows, weight) in channels.items():
        at = CHANNELS.index(name)
        part = rows.select("qid", "doc_id", F.lit(name).alias("source"), (F.lit(float(weight)) / (p.rrf_k + F.col("rank"))).alias("add"), (at * 1_000_000 + F.col("rank")).alias("order"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("qid", "doc_id").agg(F.round(F.sum("add"), 6).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("order").alias("tie"))


def top_fused(fused: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "tie", "doc_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k)


def relevance_gate(number_hits: DataFrame, max_sims: DataFrame, queries: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(qid, max_sim, relevant): a number match, or the corpus-wide best similarity reaches the minimum."""
    hits = number_hits.select("qid").distinct().withColumn("by_number", F.lit(True))
    joined = queries.select("qid").join(max_sims, "qid", "left").join(hits, "qid", "left")
    best = F.coalesce("max_sim", F.lit(0.0))
    return joined.select("qid", best.alias("max_sim"), (F.coalesce("by_number", F.lit(False)) | (best >= p.relevance_min)).alias("relevant"))


def context_filter(results: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """results(qid, doc_id, rank, sim, max_sim, sources) with in_context.

    Best similarity not above zero: all. Any number match: only those. Else similarity (4 places) at least context_ratio
    of the best; if that leaves fewer than context_min, the first context_min by rank instead.
    """
    own = W.partitionBy("qid")
    number = F.array_contains("sources", "number")
    near = F.round("sim", 4) >= F.col("max_sim") * p.context_ratio
    rows = results.withColumns({"_any": F.max(number).over(own), "_near": F.count_if(near).over(own)})
    chosen = F.when(F.col("max_sim") <= 0, True).when(F.col("_any"), number).when(F.col("_near") >= p.context_min, near).otherwise(F.col("rank") <= p.context_min)
    return rows.withColumn("in_context", chosen).drop("_any", "_near")

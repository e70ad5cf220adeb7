"""Retrieval and answer evaluation, parameter grids, and corpus-integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.operators.bounded import top_rows
from lexmill.sources.tables import materialize

#: Numbers that one window orders.
NUMBER_BUCKET = 1 << 20
#: Missing numbers that are spelled out at most.
MOST_MISSING = 1_000_000_000
CHECKS = ("empty", "short", "contaminated", "longest", "shortest", "repeated", "gap")
#: The head of an article inside another's text.
HEAD_INSIDE = r"(?i)\bMADDE\s+\d+\s*-"


def first_hits(results: DataFrame, relevant: Column, queries: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Per query the rank of its first relevant result (null if none), hit@1/3/5 and the reciprocal rank."""
    best = results.where(relevant).groupBy(*keys).agg(F.min("rank").alias("first_hit"))
    out = queries.join(best, list(keys), "left")
    at = F.coalesce("first_hit", F.lit(1 << 30))
    return out.withColumns({"hit1": at <= 1, "hit3": at <= 3, "hit5": at <= 5, "rr": F.coalesce(1 / F.col("first_hit"), F.lit(0.0))})


def half_up(x: Column, digits: int) -> Column:
    """Rounded half up; the sum's order, and so its last bits, can't turn a tie."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5 + 1e-6).cast("double") / scale


def percent(test: Column) -> Column:
    """Share of rows in percent with one decimal; 0 for no rows."""
    return F.coalesce(half_up(100 * F.avg(F.when(test, 1.0).otherwise(0.0)), 1), F.lit(0.0))


def summary(hits: DataFrame, *by: str) -> DataFrame:
    """Rates at 1, 3 and 5, mean reciprocal rank, and the number of missed queries."""
    cols = [percent(F.col(f"hit{k}")).alias(f"hit_at_{k}") for k in (1, 3, 5)]
    cols += [F.coalesce(half_up(F.avg("rr"), 4), F.lit(0.0)).alias("mrr"), F.count_if(F.col("first_hit").isNull()).alias("missed"), F.count("*").alias("n")]
    return hits.groupBy(*by).agg(*cols) if by else hits.agg(*cols)


def report(rows: DataFrame, k: int = 20) -> DataFrame:
    """One row of measures over rows(id, answerable, first_hit, hit1, hit3, hit5, rr, relevant) of a question set: rates of the
    answerable questions, the gate's accuracy on both classes, and the first ``k`` ids without a hit.

    Rows with cited_expected, unsupported, refused, success, auto_cited, error and generation_ms give the measures of answers
    too; times are merged as quantile sketches, so no task holds them all.
    """
    yes, no = F.col("answerable"), ~F.col("answerable")
    over = lambda test, among: F.coalesce(half_up(100 * F.avg(F.when(among, F.when(test, 1.0).otherwise(0.0))), 1), F.lit(0.0))
    cols = [F.count("*").alias("questions"), F.count_if(yes).alias("answerable"), F.count_if(no).alias("out_of_scope")]
    cols += [over(F.col(f"hit{n}"), yes).alias(f"hit_at_{n}") for n in (1, 3, 5)]
    cols += [F.coalesce(half_up(F.avg(F.when(yes, F.col("rr"))), 4), F.lit(0.0)).alias("mrr"), F.count_if(yes & F.col("first_hit").isNull()).alias("missed")]
    cols += [over(F.col("relevant"), yes).alias("gate_answerable"), over(~F.col("relevant"), no).alias("gate_out_of_scope")]
    if "success" in rows.columns:
        ms = F.when(F.col("generation_ms") > 0, F.col("generation_ms"))
        cols += [over(F.col("cited_expected"), yes).alias("cited_expected"), F.count_if(F.size("unsupported") > 0).alias("with_unsupported"), over(F.col("refused"), no).alias("refused"), percent(F.coalesce("success", F.lit(False))).alias("success")]
        cols += [F.count_if(F.col("error") != "").alias("errors"), F.count_if(yes & F.col("auto_cited")).alias("auto_cited"), F.coalesce(F.round(F.avg(ms), 1), F.lit(0.0)).alias("mean_ms"), F.coalesce(F.round(F.percentile_approx(ms, 0.5), 1), F.lit(0.0)).alias("median_ms")]
    lost = top_rows(rows.where(yes & F.col("first_hit").isNull()).select(F.lit(0).alias("all"), "id"), ["all"], [("id", True)], k)
    ids = lost.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("missed_ids"))  # k rows at most
    return rows.agg(*cols).crossJoin(ids)  # one row each


def grid_results(ranked: DataFrame, params: DataFrame, k: int = 5, rrf_k: int = 60) -> DataFrame:
    """Fused top-k for every parameter row at once.

    ranked(qid, doc_id, channel, variant, rank) holds each channel's candidates up to the largest pool; params(param_id,
    pool, w_vector, w_lexical, w_number, lexical_variant) is small by construction, so it meets the candidates by an
    equi-join per channel and is one job, not one per row.
    """
    use = F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias("channel"), v.alias("variant"), F.col(w).alias("w"))
                for c, v, w in (("vector", F.lit("-"), "w_vector"), ("lexical", F.col("lexical_variant"), "w_lexical"), ("number", F.lit("-"), "w_number"))
            ]
        )
    )
    wanted = params.select("param_id", "pool", use)
    hits = ranked.join(wanted, ["channel", "variant"]).where((F.col("channel") == "number") | (F.col("rank") <= F.col("pool")))
    place = F.when(F.col("channel") == "vector", 0).when(F.col("channel") == "lexical", 1_000_000).otherwise(2_000_000) + F.col("rank")
    fused = hits.groupBy("param_id", "qid", "doc_id").agg(F.round(F.sum(F.col("w") / (rrf_k + F.col("rank"))), 6).alias("score"), F.min(place).alias("tie"))
    rank = F.row_number().over(W.partitionBy("param_id", "qid").orderBy(F.desc("score"), "tie", "doc_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k)


def missing_ranges(found: DataFrame, number: str, *by: str) -> DataFrame:
    """(by, first, last): the gaps between 1 and the greatest number of each group, one row a gap however wide it is.

    Nulls and numbers below 1 are ignored. Gaps are found between neighbours inside buckets of NUMBER_BUCKET numbers, so a
    crowded group is many windows; what precedes a bucket's first number comes from a table of one row a bucket.
    """
    own = found.where(F.col(number) >= 1).select(*by, F.col(number).cast("long").alias("number")).distinct()
    own = own.withColumn("bucket", F.floor(F.col("number") / NUMBER_BUCKET))
    last = own.groupBy(*by, "bucket").agg(F.max("number").alias("last"))
    last = last.select(*by, "bucket", F.coalesce(F.lag("last").over(W.partitionBy(*by).orderBy("bucket")), F.lit(0)).alias("earlier"))
    inside = F.lag("number").over(W.partitionBy(*by, "bucket").orderBy("number"))
    same = [F.col(f"own.{c}").eqNullSafe(F.col(f"last.{c}")) for c in (*by, "bucket")]
    met = own.withColumn("inside", inside).alias("own").join(last.alias("last"), reduce(lambda a, c: a & c, same))
    gaps = met.select(*[F.col(f"own.{c}") for c in by], "number", F.coalesce("inside", "earlier").alias("before")).where("number - before > 1")
    return gaps.select(*by, (F.col("before") + 1).alias("first"), (F.col("number") - 1).alias("last"))


def missing_numbers(found: DataFrame, number: str, *by: str, most: int = MOST_MISSING) -> DataFrame:
    """The numbers in missing_ranges, spelled out. They are counted first: more than ``most`` raise, ranges say it then."""
    gaps = missing_ranges(found, number, *by)
    n = gaps.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
    if n > most:
        raise ValueError(f"{n} numbers are missing, {most} may be spelled out; use missing_ranges")
    pieces = gaps.select(*by, "last", F.explode(F.sequence("first", "last", F.lit(NUMBER_BUCKET))).alias("from"))
    return pieces.select(*by, F.explode(F.sequence("from", F.least(F.col("last"), F.col("from") + NUMBER_BUCKET - 1))).alias("number"))


def audit(articles: DataFrame, short: int = 40, k: int = 3) -> DataFrame:
    """Findings over articles(law, article_no long, content): (check, law, rank, article_no, value).

    For every law and check a row of rank 0 holds in value how many there are, and the rows of rank 1 to k the first ones:
    * empty, short (fewer than ``short`` characters), contaminated (another article's head inside): by number; value: characters
    * longest, shortest: by length; value: characters (their count is that of the articles)
    * repeated: numbers that several rows have; value: rows
    * gap: runs of missing numbers from article_no to value; their count is that of the missing numbers
    Null texts are empty, null laws one law; articles without a number are in no gap and not repeated, and come last.

    One pass over the texts, when this is called; each task keeps k rows a law and check.
    """
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "")
    seen = articles.select("law", F.col("article_no").cast("long").alias("article_no"), text.alias("_t"))
    seen = seen.select("law", "article_no", F.length("_t").cast("long").alias("value"), (F.col("_t").rlike(HEAD_INSIDE) | F.startswith("_t", F.lit("(1)"))).alias("_mixed"))
    seen = materialize(seen, "audit")  # the texts are read once; what follows works on numbers
    tests = {"empty": F.col("value") == 0, "short": F.col("value").between(1, short - 1), "contaminated": F.col("_mixed")}
    row = lambda check, by: F.struct(F.lit(check).alias("check"), by.cast("long").alias("_by"))
    marks = F.array(row("longest", -F.col("value")), row("shortest", F.col("value")), *[F.when(t, row(c, F.lit(0))) for c, t in tests.items()])
    flagged = seen.select("law", "article_no", "value", F.inline(F.array_compact(marks)))
    numbers = seen.where("article_no is not null").groupBy("law", "article_no").agg(F.count("*").alias("value")).where("value > 1")
    gaps = missing_ranges(seen, "article_no", "law")
    same = lambda df, check, no, value: df.select("law", F.col(no).alias("article_no"), F.col(value).alias("value"), F.lit(check).alias("check"), F.lit(0).cast("long").alias("_by"))
    every = flagged.unionByName(same(numbers, "repeated", "article_no", "value")).unionByName(same(gaps, "gap", "first", "last"))
    first = top_rows(every, ["law", "check"], [("_by", True), ("article_no", True)], k).drop("_by")

    totals = seen.groupBy("law").agg(F.count("*").alias("longest"), F.count("*").alias("shortest"), *[F.count_if(t).alias(c) for c, t in tests.items()])
    more = numbers.groupBy("law").agg(F.count("*").alias("repeated")).alias("n"), gaps.groupBy("law").agg(F.sum(F.col("last") - F.col("first") + 1).alias("gap")).alias("g")
    totals = totals.alias("t")
    for other in more:
        name = "n" if other is more[0] else "g"
        totals = totals.join(other, F.col("t.law").eqNullSafe(F.col(f"{name}.law")), "left")
    counts = F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(c, F.lit(0)).cast("long").alias("value")) for c in CHECKS])
    zero = totals.select(F.col("t.law").alias("law"), F.inline(counts)).withColumns({"rank": F.lit(0), "article_no": F.lit(None).cast("long")})
    return zero.unionByName(first).select("check", "law", "rank", "article_no", "value")


def integrity(chunks: DataFrame, short: int = 40) -> DataFrame:
    """One row of counts over chunks(source, article_no, label, heading, topic, part_no, parts, content)."""
    n = F.length("content")
    totals = chunks.agg(
        F.count("*").alias("chunks"), F.count_distinct("source", "article_no").alias("articles"), F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (n < short)).alias("short"),
        F.count_if(F.col("content").rlike(r"MADDE \d+\s*[-–]")).alias("contaminated"), F.count_if(F.coalesce("heading", F.lit("")) == "").alias("no_heading"),
        F.count_if(F.coalesce("topic", F.lit("")) == "").alias("no_topic"), F.round(F.avg(n), 1).alias("mean_chars"), F.max(n).alias("longest"), F.min(n).alias("shortest"),
    )
    twice = chunks.groupBy("source", "article_no").agg(F.count("*").alias("n"), F.max("parts").alias("p")).agg(F.count_if((F.col("n") > 1) & (F.col("p") <= 1)).alias("repeated_numbers"))
    labels = chunks.groupBy("label").count().agg(F.count_if(F.col("count") > 1).alias("repeated_labels"))
    return totals.crossJoin(twice).crossJoin(labels)  # one row each


def reassemble(chunks: DataFrame, *by: str) -> DataFrame:
    """Each article's chunks joined in order."""
    parts = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("part_no", "content"))).alias("p"))
    return parts.select(*by, F.array_join(F.transform("p", lambda x: x["content"]), "\n").alias("text"), F.size("p").alias("parts"))


def reassemble_pieces(chunks: DataFrame, *by: str, size: int = 1 << 20) -> DataFrame:
    """The same in pieces, for articles of any length: (by, piece, first_part, parts, text). A piece holds the chunks, in order,
    that begin in one stretch of ``size`` characters, so no row is longer than that and its last chunk; the joined pieces are
    the article. The running length is a window that keeps one number a group, however many chunks there are.
    """
    own = W.partitionBy(*by).orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("content") + 1).over(own), F.lit(0))
    placed = chunks.withColumn("piece", F.floor(before / size).cast("long"))
    parts = placed.groupBy(*by, "piece").agg(F.array_sort(F.collect_list(F.struct("part_no", F.coalesce("content", F.lit("")).alias("content")))).alias("p"))
    return parts.select(*by, "piece", F.element_at("p", 1)["part_no"].alias("first_part"), F.size("p").alias("parts"), F.array_join(F.transform("p", lambda x: x["content"]), "\n").alias("text"))

"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Everything is a DataFrame expression. Tokens (letter runs, digit runs, punctuation runs) and pairs of neighbours are
hashed into BUCKETS. Two multinomials, one over the trusted documents and one over all, are counted in one aggregation.
A document's verdict is the mean over its n-grams of log p_target - log p_raw, against a fixed threshold. Weights are
whole numbers (WEIGHT_SCALE a nat), so sums don't depend on their order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.columns import count_of, let, lines_of, marked, spare_name, words_of

BUCKETS = 1 << 14
SMOOTHING = 1.0
WEIGHT_SCALE = 10_000
#: Documents with a mean log ratio below this many nats an n-gram are rejected.
THRESHOLD = -0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: Places of windows that fit beside the upper bits of a hash.
_PLACES = (1 << 20) - 1
TOKEN = r"[\p{L}\p{M}]+|[0-9]+|[^\p{L}\p{M}0-9\x20\x09-\x0D]+"


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more. Windows are compared by a 64-bit hash."""
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )

    def united(places: Column) -> Column:
        gains = let(places, lambda p: F.transform(p, lambda x, k: F.when(k == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), x - F.get(p, k - 1)))))
        return F.aggregate(gains, F.lit(0).cast("long"), lambda a, x: a + x)

    def covered(h: Column) -> Column:
        """Sorts numbers made of a window's upper hash bits and its place; neighbours are then compared by the whole hash."""
        ordered = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(~_PLACES).bitwiseOR(i.cast("long"))))
        whole = let(ordered, lambda s: F.transform(s, lambda x: F.struct(F.get(h, x.bitwiseAND(_PLACES).cast("int")).alias("h"), x.bitwiseAND(_PLACES).alias("i"))))
        return united(F.sort_array(again(whole)))

    def covered_long(h: Column) -> Column:
        """The same for texts with more windows than places fit into a number."""
        return united(F.sort_array(again(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))))))

    def again(ordered: Column) -> Column:
        """Places of the windows equal to a neighbour."""
        same = let(ordered, lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        return F.transform(same, lambda x: x["i"])

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).when(F.size(h) <= _PLACES, covered(h)).otherwise(covered_long(h)))


def rule_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (null text: empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words, lines = spare_name(docs, "_words"), spare_name(docs, "_lines")
    out = docs.withColumns({words: words_of(text), lines: lines_of(text)})
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": count_of(text, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeat_words(F.col(words)),
        }
    ).drop(words, lines)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def ngram_buckets(text: Column) -> Column:
    """Buckets of a text's tokens and of its neighbouring pairs."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    bucket = lambda *x: F.xxhash64(*x).bitwiseAND(BUCKETS - 1).cast("int")
    single = lambda t: F.transform(t, lambda w: bucket(w))
    double = lambda t: F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda w, i: bucket(w, F.get(t, i + 1)))
    return let(tokens, lambda t: F.concat(single(t), double(t)))


def fit_weights(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> list[int]:
    """Log ratios of all buckets. trusted: table of ids. No trusted document: all zero, so that nothing is rejected."""
    seen = marked(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), trusted, id_col, "_trusted")
    grams = seen.select("_trusted", F.explode(ngram_buckets(F.col("_text"))).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("_trusted").alias("target")).collect()  # BUCKETS rows at most
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.b], target[r.b] = r.raw, r.target
    n_raw, n_target = sum(raw) + SMOOTHING * BUCKETS, sum(target) + SMOOTHING * BUCKETS
    if not sum(target):
        return [0] * BUCKETS
    ratio = lambda t, r: math.log((t + SMOOTHING) / n_target) - math.log((r + SMOOTHING) / n_raw)
    return [round(WEIGHT_SCALE * ratio(t, r)) for t, r in zip(target, raw)]


def log_ratio(text: Column, weights: list[int]) -> Column:
    """Mean log ratio of a text's n-grams in nats; 0 without any."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded to one literal
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + F.get(table, x))
    return let(ngram_buckets(text), lambda b: F.when(F.size(b) == 0, 0.0).otherwise(total(b) / F.size(b) / WEIGHT_SCALE))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents marked good and not toxic (null toxic counts as not)."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


def apply_rules(docs: DataFrame, weights: list[int], text_col: str = "text") -> DataFrame:
    """docs with the rule columns, log_ratio and kept.

    Null or empty texts have zero counts and fail the base rules; repeated rows are judged alike; other columns pass
    through, and columns with the names of results are replaced. An empty table stays empty.
    """
    out = rule_columns(docs, text_col)
    out = out.withColumn("log_ratio", log_ratio(F.col(text_col).cast("string"), weights))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= THRESHOLD))

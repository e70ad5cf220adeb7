"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics, compiled into one column.

Shallow trees are boosted on a bounded sample of labelled documents; every path from a root becomes a rule (a
conjunction of threshold tests); lasso logistic regression weighs the rules; those with a weight become WHEN terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.columns import count_of, lines_of, words_of

#: Labelled rows that the classifier is fitted on at most, chosen by hash of doc_id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 24, 3, 32, 0.3, 20
PENALTY = 2e-3
CUT = 0.7
STATISTICS = (
    "log_words", "word_chars", "distinct", "symbols", "pipes", "marks", "stops", "capitals", "digits", "commas", "short", "long", "twins", "dup_lines", "line_words", "sentence_words",
)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one double column a statistic of the text, all defined for null and empty texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumns({"_w": words_of(text), "_l": lines_of(text)})
    w, n = F.col("_w"), F.greatest(F.size("_w"), F.lit(1))
    chars = F.greatest(F.length(text), F.lit(1))
    count = lambda test: F.size(F.filter(w, test))
    columns = {
        "log_words": F.log1p(F.size(w)),
        "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / n,
        "distinct": F.size(F.array_distinct(w)) / n,
        "symbols": count_of(text, "#*$%&<>@^~=_{}[]\\") / chars,
        "pipes": count_of(text, "|") / n,
        "marks": count_of(text, "!?") / n,
        "stops": count_of(text, ".") / n,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "digits": count_of(text, "0123456789") / chars,
        "commas": count_of(text, ",;:") / n,
        "short": count(lambda x: F.length(x) <= 3) / n,
        "long": count(lambda x: F.length(x) >= 12) / n,
        "twins": F.size(F.filter(F.transform(w, lambda x, i: F.get(w, i + 1) == x), lambda x: x)) / n,
        "dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))) / F.greatest(F.size("_l"), F.lit(1)),
        "line_words": F.size(w) / F.greatest(F.size("_l"), F.lit(1)),
        "sentence_words": F.size(w) / F.greatest(count_of(text, "."), F.lit(1)),
    }
    return out.withColumns({k: F.round(v.cast("double"), 9) for k, v in columns.items()}).drop("_w", "_l")


@dataclass
class RuleModel:
    """score = 1 / (1 + exp(-(bias + sum of weights of rules that hold))); a rule is a list of (statistic, above, cut)."""

    bias: float
    rules: list[tuple[list[tuple[str, bool, float]], float]]

    def column(self) -> Column:
        z = F.lit(float(self.bias))
        for tests, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in tests:
                holds = holds & ((F.col(name) > cut) if above else (F.col(name) <= cut))
            z = z + F.when(holds, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.full(len(rows), self.bias)
        for tests, weight in self.rules:
            z += weight * _holds(rows, tests)
        return 1 / (1 + np.exp(-z))


def _holds(rows: np.ndarray, tests: list[tuple[str, bool, float]]) -> np.ndarray:
    ok = np.ones(len(rows), bool)
    for name, above, cut in tests:
        x = rows[:, STATISTICS.index(name)]
        ok &= x > cut if above else x <= cut
    return ok


def _grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, at: np.ndarray, depth: int, path: tuple, found: list) -> np.ndarray:
    """One regression tree on gradients; returns its step for the rows ``at`` and appends (path, ...) of every node."""
    g, h = grad[at].sum(), hess[at].sum()
    value = np.full(len(at), -RATE * g / (h + 1.0))
    if depth == 0 or len(at) < 2 * LEAST:
        return value
    best = (1e-6, None, None)
    for f in range(bins.shape[1]):
        b = bins[at, f]
        gs, hs, ns = (np.bincount(b, weights, BINS)[:-1].cumsum() for weights in (grad[at], hess[at], None))
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < LEAST) | (len(at) - ns < LEAST)] = 0
        if gain.max() > best[0] * (1 + 1e-9):
            best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        return value
    _, f, k = best
    right = bins[at, f] > k
    for side, above in ((~right, False), (right, True)):
        step = (*path, (f, above, k))
        found.append(step)
        value[side] = _grow(bins, grad, hess, at[side], depth - 1, step, found)
    return value


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the bias: accelerated proximal gradient."""
    n, d = r.shape
    x = np.hstack([r, np.ones((n, 1))])
    v = np.ones(d + 1)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(np.linalg.norm(x @ v) ** 2, 1e-9)
    w = z = np.zeros(d + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ z)))
        new = z - rate * (x.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (old - 1) / t * (new - w), new
    return w[-1], w[:-1]


def fit(rows: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleModel:
    """rows: one column a statistic; y: 0 or 1. Without both classes the score is constant: 1 if no 0 was seen."""
    if not len(y) or y.min() == y.max():
        good = float(y.sum()) if len(y) else 0.0
        share = (good + 1) / (len(y) + 1) if good == len(y) else 1 / (len(y) + 2)
        return RuleModel(float(np.log(share / max(1 - share, 1e-9))), [])
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(rows.shape[1])]
    bins = np.column_stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)])
    margin, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + _grow(bins, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), found)
    paths = list(dict.fromkeys(tuple(sorted(set(p))) for p in found))
    named = [[(STATISTICS[f], above, float(cuts[f][k])) for f, above, k in p] for p in paths]
    if not named:
        return RuleModel(float(margin[0]), [])
    held = np.column_stack([_holds(rows, t) for t in named]).astype(float)
    bias, weights = _lasso(held, y.astype(float), penalty)
    return RuleModel(float(bias), [(t, float(w)) for t, w in zip(named, weights) if abs(w) > 1e-4])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents that aren't held out (but for chance, one in 10^9), one row an id and label.

    Labels other than 0 and 1 are ignored. Ids are chosen by a threshold on their hash, so no task sorts or sends more than
    its share of the sample; of several documents with one id the least statistics count.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
    own = own.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    n, spread = own.count(), 1 << 30
    if n > sample_rows:
        most = int(spread * max(0.0, sample_rows - 6 * sample_rows**0.5) / n)
        own = own.where(F.pmod(F.xxhash64("_id", F.lit(10)), F.lit(spread)) < most)
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    seen = statistics(texts.join(F.broadcast(own), F.col("_doc") == F.col("_id")), "_text")
    one = seen.groupBy("_id", "_y").agg(F.min(F.struct(*STATISTICS)).alias("_s"))
    got = sorted(tuple(r) for r in one.select("_id", "_y", "_s.*").collect())
    table = np.array(got, float).reshape(len(got), 2 + len(STATISTICS))
    return fit(table[:, 2:], table[:, 1])


def score(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """docs with score and predicted. Null and empty texts are scored too; columns of these names are replaced."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    inner = docs.select(F.struct(*keep).alias("_row") if keep else F.struct(F.lit(1)).alias("_row"), F.col(text_col).alias("_text"))
    out = statistics(inner, "_text").select("_row.*", model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import quality_rules, rule_ensemble

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a b c a b c a b c", "x\n\nx\nx y\nx", "# $ &\x85 ü", "w " * 3000, "ab " * 2 + "cd ab ab cd", "z" * 20000]


def slow_rules(text):
    t = text or ""
    w = WORD.findall(t)
    win = Counter(zip(w, w[1:], w[2:]))
    hit = {k + d for k in range(len(w) - 2) if win[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def as_rows(df):
    return sorted((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in df.collect())


def test_rules_whole_table_and_odd(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert as_rows(quality_rules.rule_columns(d)) == sorted((r.doc_id, slow_rules(r.text)) for r in d.collect())
    odd = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD)], "doc_id long, text string, n_words int")
    assert as_rows(quality_rules.rule_columns(odd)) == sorted((i, slow_rules(t)) for i, t in enumerate(ODD))


def test_weights_and_verdict_against_plain_counts(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trusted = quality_rules.trusted_ids(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    weights = quality_rules.fit_weights(d, trusted)
    grams = {r.doc_id: r.b for r in d.select("doc_id", quality_rules.ngram_buckets(F.col("text")).alias("b")).collect()}
    good = {r.doc_id for r in trusted.collect()}
    raw, target = Counter(), Counter()
    for i, b in grams.items():
        raw.update(b)
        target.update(b if i in good else [])
    n, m, s = quality_rules.BUCKETS, quality_rules.SMOOTHING, quality_rules.WEIGHT_SCALE
    want = [round(s * (math.log((target[b] + m) / (target.total() + m * n)) - math.log((raw[b] + m) / (raw.total() + m * n)))) for b in range(n)]
    assert weights == want
    for r in quality_rules.apply_rules(d, weights).collect():
        mean = sum(want[b] for b in grams[r.doc_id]) / max(1, len(grams[r.doc_id])) / s
        assert r.log_ratio == pytest.approx(mean) and r.kept == (not r.base_failed and mean >= quality_rules.THRESHOLD)


def test_ngrams_are_tokens_and_pairs(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "text string")
    got = df.select("text", F.size(quality_rules.ngram_buckets(F.col("text"))).alias("n")).collect()
    for r in got:
        import regex

        k = len(regex.findall(r"[\p{L}\p{M}]+|[0-9]+|[^\p{L}\p{M}0-9\x20\x09-\x0D]+", r.text or ""))
        assert r.n == k + max(0, k - 1)


def test_no_trusted_and_empty(spark):
    d = spark.createDataFrame([(1, "good words " * 60), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    weights = quality_rules.fit_weights(d, none)
    assert not any(weights)
    assert quality_rules.apply_rules(d.limit(0), weights).count() == 0


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = rule_ensemble.score(d, rule_ensemble.train(d, labels)).withColumn("held_out", rule_ensemble.held_out(F.col("doc_id")))
    rows = out.join(labels, "doc_id").where("held_out").select("doc_id", "quality", "predicted", "score").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and len(rows) > 500
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_column_equals_numpy_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = rng.random((600, len(rule_ensemble.STATISTICS)))
    y = ((rows[:, 3] < 0.4) & (rows[:, 6] > 0.2)).astype(float)
    model = rule_ensemble.fit(rows, y)
    assert np.mean((model.scores(rows) > 0.5) == y) > 0.95 and 0 < len(model.rules) < 80
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], list(rule_ensemble.STATISTICS))
    assert np.allclose([r.s for r in df.select(model.column().alias("s")).collect()], model.scores(rows))
    odd = spark.createDataFrame([(i, t, "s", -1.0) for i, t in enumerate(ODD)], "doc_id long, text string, digits string, score double")
    out = rule_ensemble.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.digits == "s" for r in out)


def test_untrained(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = rule_ensemble.score(d, rule_ensemble.train(d, labels)).collect()
    assert [r.predicted for r in out] == [1, 1]
    assert rule_ensemble.score(d.limit(0), rule_ensemble.train(d.limit(0), labels)).count() == 0


def test_sample_by_threshold(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 4000)
    d = spark.createDataFrame([(i, "good words here. " * 5 if v else "# $ ! | " * 9) for i, v in enumerate(map(int, y))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(map(int, y))], "doc_id long, quality int")
    seen = []
    rows = rule_ensemble.fit
    try:
        rule_ensemble.fit = lambda x, z: seen.append(len(z)) or rows(x, z)
        model = rule_ensemble.train(d.unionByName(d.limit(50)), labels.unionByName(labels), sample_rows=900)
        rule_ensemble.train(d.unionByName(d), labels, sample_rows=10_000)
    finally:
        rule_ensemble.fit = rows
    learned = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(4000))
    assert 500 < seen[0] <= 900 and seen[1] == learned
    got = {r.doc_id: r.predicted for r in rule_ensemble.score(d, model).collect()}
    assert np.mean([got[i] == v for i, v in enumerate(y)]) > 0.99

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import importance

DOCS, BENCH = "/root/testdata/sf0.001/documents.parquet", "/root/testdata/sf0.001/benchmark.parquet"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text, longest):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def slow(docs, target, longest=1, buckets=importance.BUCKETS, percent=10, least=20):
    """Brute force: rows (doc_id, n_features, weight, score, rank), sorted."""
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(at, runs_of(x, longest)[1]))
    for x in target:
        t.update(map(at, runs_of(x, longest)[1]))
    n, m = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        w, f = runs_of(x, longest)
        weight = sum(gain[at(r)] for r in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fits = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fits[: len(fits) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_whole_table_against_brute_force(spark, longest):
    docs, target = spark.read.parquet(DOCS), spark.read.parquet(BENCH)
    want = slow([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], longest)
    assert got(importance.resample(docs, target, longest=longest)) == want
    assert sum(r[4] is not None for r in want) > 10


def test_odd_rows_ties_repeats_and_clashing_columns(spark):
    long = "Straße ÜBER naïve " * 40_000
    rows = [(1, None), (2, ""), (3, "\x00 -- !"), (4, long), (5, "one two"), (None, "alpha " * 30), (None, "alpha " * 30), (7, "beta Gamma " * 15), (7, "beta Gamma " * 15), (7, "beta gamma\u0080 " * 15)]
    rows += [(k, "word more 12 " * 9) for k in range(10, 90)]
    df = spark.createDataFrame([(*r, 1.5, "x", 9) for r in rows], "doc_id long, text string, score double, rank string, n_words int").repartition(7)
    target = spark.createDataFrame([("beta and more",), (None,), ("",)], "text string")
    out = importance.resample(df, target, longest=2, percent=30, keep=("score", "text"))
    assert got(out) == slow(rows, ["beta and more", None, ""], 2, percent=30)
    assert out.columns[-1] == "row" and out.where("row.text is not null").count() == len(rows) - 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert got(importance.resample(none, some.select("text"))) == []
    assert got(importance.resample(some, none.select("text"))) == slow([(1, "a b"), (2, None)], [])


def test_emptied_tries_change_nothing(monkeypatch):
    texts = [f"w{k} w{k % 7} again {k}" for k in range(300)]
    whole = importance.WordTrie(3, 50)
    whole.walk(pa.array(texts))
    monkeypatch.setattr(importance, "MOST_NODES", 40)
    small = importance.WordTrie(3, 50)
    for k in range(0, 300, 10):
        small.walk(pa.array(texts[k : k + 10]))
    assert np.array_equal(whole.flush(), small.flush())


def test_slices_without_nulls_are_walked_whole():
    texts = pa.array([f"Text {k} HAS Wörds" * (k % 7) for k in range(900)])
    whole, parts = importance.WordTrie(2, 500), importance.WordTrie(2, 500)
    runs = whole.walk(texts)[1]
    assert np.array_equal(np.concatenate([parts.walk(texts.slice(k, 300))[1] for k in (0, 300, 600)]), runs)
    assert np.array_equal(whole.flush(), parts.flush())


def test_batches_of_several_pieces_against_brute_force(spark):
    rows = [(k, f"Word{k} word{k % 13} UP{k % 7} " * 900) for k in range(300)]
    assert sum(len(x) for _, x in rows) > importance.PIECE_BYTES
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    target = spark.createDataFrame([("up3 word5",)], "text string")
    assert got(importance.resample(df, target)) == slow(rows, ["up3 word5"])


def test_state_goes_on_from_the_parent():
    trie = importance.WordTrie(3, 10)
    trie.walk(pa.array(["Der Weg nach nebenan"]))
    assert {"der", "der weg", "der weg nach", "weg nach nebenan"} <= {r for r in runs_of("Der Weg nach nebenan", 3)[1] if zlib.crc32(r.encode()) in set(trie.state[1 : trie.nodes].tolist())}


def test_one_hot_score_is_ranked_over_many_ranges(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(25).cast("long").alias("n_words"), F.lit(5).cast("long").alias("score"))
    ranks = importance.draw(df, 50)
    assert sorted(r.rank for r in ranks.where("rank is not null").collect()) == list(range(1, 2001)) and ranks.count() == 4000

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import boosting, queries, toxicity

DIR = "/root/testdata/sf0.1"
LEX = toxicity.Lexicon(["idiot", "clown", "ass ", "weak"], np.array([4.0, 3.5, 2.5, 1.2]))


def row(text):
    return dict(zip(toxicity.FEATURES, toxicity.features(pa.array([text]), LEX)[0]))


def test_held_out_accuracy_on_the_whole_table(spark):
    """Labels are partly noise: a share of the junk documents is marked toxic at random."""
    out = queries.op11_toxicity(spark, DIR)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 10_000
    seen = out.join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    held = [r for r in seen if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in seen)
    good = [r for r in held if r.toxic == 0]
    bad = [r for r in held if r.toxic == 1]
    assert sum(r.predicted for r in good) <= 0.005 * len(good)
    assert sum(r.predicted for r in bad) >= 0.88 * len(bad)
    # calibrated: rows scored high are toxic as often as the scores say
    high = [r for r in held if r.score >= 0.5]
    assert abs(sum(r.score for r in high) - sum(r.toxic for r in high)) <= 0.05 * len(high)


def test_held_out_labels_and_ids_are_never_used(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.train(docs, x) for x in (labels, turned))
    assert one.lexicon.keys == two.lexicon.keys and np.array_equal(one.rate, two.rate)
    moved = docs.select((F.col("doc_id") + 5).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    got = lambda d, by: {r[0]: r[1] for r in toxicity.score(d, one).select(F.col("doc_id") - by, "score").collect()}
    assert got(docs, 0) == got(moved, 5)


def test_features_of_words():
    plain = row("you are an IDIOT ! what a clown")
    assert plain["clear"] == pytest.approx(2 / 8) and plain["strong"] == plain["clear"] and plain["max_weight"] == 4.0
    assert plain["capitals"] == 1 / 8 and plain["exclaims"] == 1 / 8 and plain["near_share"] == 0.5 and plain["you"] == 1 / 8
    assert row("x " * 9 + "you idiot")["near_share"] == 1.0 and row("you " + "x " * 9 + "idiot")["near_share"] == 0.0
    assert row("assistant")["clear"] == 0 and row("ass.")["clear"] == 1 and row("weak point")["weak"] == 0.5 and row("weak point")["clear"] == 0


@pytest.mark.parametrize("word", ["1d10t", "id1ot!", "IDIOOOOT", "i-d-i-o-t", "i.d.i.o.t", "1diot", "i*d*i*o*t?", "Idiot5"])
def test_disguised_words_are_found(word):
    got = row(f"some {word} here")
    assert got["clear"] == pytest.approx(1 / 3), word


def test_letters_set_apart_end_with_their_text():
    assert row("an i d i o t there")["apart_hits"] == pytest.approx(1 / 7)
    split = toxicity.features(pa.array(["so i d i", "o t and", None, "c l o w n"]), LEX)[:, toxicity.FEATURES.index("apart_hits")]
    assert split.tolist() == [0, 0, 0, 0.2]


def test_density_against_a_plain_loop(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(300).collect()]  # rows of a fixture
    lex = toxicity.Lexicon(["the", "und", "ción", "la "], np.array([1.5, 2.5, 3.5, 2.0]))
    got = toxicity.features(pa.array(texts), lex)
    for text, x in zip(texts, got):
        words = (text or "").encode("utf8", "surrogatepass").decode("utf8").split()
        core = [w.lower().strip("".join({c for c in w.lower() if not c.isalnum()})) for w in words]
        weight = [max([v for k, v in zip(lex.keys, lex.weights) if (c + " ").startswith(k) and (k[-1] != " " or c + " " == k)], default=0) for c in core]
        odd = toxicity.split(pa.array([text])).odd.any()
        if not odd:
            assert x[2] == pytest.approx(sum(v >= 2 for v in weight) / max(1, len(words))) and x[0] == pytest.approx(np.log1p(len(words)))


def test_odd_rows_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "you idiot"), (4, "you idiot"), (4, "you idiot"), (5, "word " * 200_000), (6, "\x00$$$ 1")]
    docs = spark.createDataFrame([(*r, 3.0, "p", "r") for r in rows], "doc_id long, text string, score double, predicted string, row string")
    labels = spark.createDataFrame([(4, 1, 9), (4, 0, 9), (None, 1, 9), (5, 7, 9), (6, None, 9), (1, 0, 9)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model)
    assert sorted(out.columns) == ["doc_id", "predicted", "row", "score", "text"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.row == "r" for r in got) and len({r.score for r in got if r.text == "you idiot"}) == 1


def test_empty_tables_and_one_class(spark):
    none, docs = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(0, "a b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert all(r.score == pytest.approx(0.5, abs=0.001) for r in toxicity.score(docs, model).collect()) and toxicity.score(none, model).count() == 0
    one = toxicity.train(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert all(r.predicted == 0 for r in toxicity.score(docs, one).collect())
    toxicity.train(none, labels)


def test_sample_is_bounded_and_takes_no_hot_id_whole(spark):
    docs = spark.range(6000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert toxicity.sample(docs, labels, sample_rows=500).count() <= 500
    every = toxicity.sample(docs, labels)
    assert every.where("id = 7").count() <= 1 and every.count() == every.select("id").distinct().count()


def test_isotonic_and_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < boosting.sigmoid(3 * x[:, 0] * (x[:, 1] > 0))).astype(int)
    model = boosting.boost(x[:3000], y[:3000])
    at, rate = boosting.isotonic(model.margin(x[:3000]), y[:3000])
    assert (np.diff(rate) >= 0).all() and (np.diff(at) >= 0).all()
    p = np.interp(model.margin(x[3000:]), at, rate)
    clear = np.abs(3 * x[3000:, 0] * (x[3000:, 1] > 0)) > 2
    assert ((p > 0.5) == y[3000:])[clear].mean() > 0.85
    # pooled by hand: 0 1 | 1 0 -> the middle two share a rate
    assert boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]), prior=0)[1].tolist() == [0, 0, 0.5, 0.5, 1, 1]

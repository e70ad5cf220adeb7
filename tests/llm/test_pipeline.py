import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_pii import slow
from test_quality import slow_rules
from test_simhash import similar_groups
from test_tokens import want_ids
from tokenizers import Tokenizer

import corpus_pipeline
from lexmill.llm.wordids import default_vocabulary

DIR = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).cache()
        outs.append(docs.collect())
        if len(outs) < 5:
            assert docs.columns == columns, name
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    ruled, judged, single, masked = ({r.doc_id: r.text for r in o} for o in outs[:4])
    # rules: base failures go, good documents that pass the base stay
    assert not any(slow_rules(t)[-1] for t in ruled.values())
    assert all(i in ruled for i, t in texts.items() if quality.get(i) == 1 and not slow_rules(t)[-1])
    assert sum(quality.get(i) == 0 for i in ruled) <= 0.02 * len(ruled)
    # classifier: works on what is left and spares good documents
    assert set(judged) <= set(ruled)
    assert sum(quality.get(i) == 1 for i in judged) >= 0.98 * sum(quality.get(i) == 1 for i in ruled)
    # near-duplicates: the smallest id of each group at similarity 0.8
    assert sorted(single) == similar_groups(judged, 0.8) and all(single[i] == judged[i] for i in single)
    # PII: no base span is left, text outside spans is
    assert set(masked) == set(single)
    for i, t in masked.items():
        assert not slow(t)
        rest = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|SECRET|NATIONAL_PHONE|NATIONAL_ID|IBAN|ACCOUNT|BIRTH_DATE)\]", t)
        assert len(rest) - 1 >= (len(slow(single[i])) > 0) and all(x in single[i] for x in rest)
    assert all(r.n_chars == len(r.text) for r in outs[3])
    # packing: every id of every masked document once
    tok = Tokenizer.from_file(default_vocabulary())
    by = {}
    for p in outs[4]:
        by.setdefault(p.doc_id, []).append(p)
    assert set(by) == set(masked)
    for i, ps in by.items():
        ids, at = want_ids(tok, masked[i]), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    run = corpus_pipeline.run(spark, DIR)
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in run.collect()) and run.count() > 0
    assert {p.doc_id for p in run.collect()} == set(masked)


def test_odd_documents(spark):
    clean = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)} and" for k in range(60))
    rows = [(1, clean, "en", "s", 1), (1, clean, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, clean + " more", "en", "s", 5), (4, clean, None, "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in docs.collect()} <= {1, None, 4}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert sorted(r.doc_id or 0 for r in one.collect()) == [1, 2]
    out = corpus_pipeline.pii_stage(spark, docs, "")
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r[1]) for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_columns_named_like_results_stay(spark):
    names = ("kept", "log_ratio", "n_words", "score", "predicted", "_words", "_lines", "_row", "row", "spans", "label", "hash")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        wide = stage(spark, wide, "/root/testdata/sf0.001")
        rows = wide.collect()
        assert rows and wide.columns == [*docs.columns, *names]
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)

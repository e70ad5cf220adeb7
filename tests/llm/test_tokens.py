import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmill.llm import packing, token_files
from lexmill.llm.wordids import RunEncoder, default_vocabulary
from lexmill.sources.tables import scratch_path

ODD = [None, "", " ", "a", "<|endoftext|>x <|startoftext|>", "é é İI ﬁ", "x y z\x1ct\x85", "don't 3.14 'S\n\n.", "Ω" * 900, "." * 5000, "z" * 3000]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(default_vocabulary())


def want_ids(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), min_size=1, max_size=6))
def test_run_encoder_equals_library(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    got = _encoder.encode(pa.array(texts, pa.string()))
    assert [got.ids[a:b].tolist() for a, b in zip(got.start[:-1], got.start[1:])] == [want_ids(_encoder.tokenizer, t) for t in texts]


_encoder = RunEncoder(default_vocabulary())


def test_odd_texts(tok):
    got = _encoder.encode(pa.array(ODD, pa.string()))
    assert [got.ids[a:b].tolist() for a, b in zip(got.start[:-1], got.start[1:])] == [want_ids(tok, t) for t in ODD]


def check_pieces(pieces, texts, tok, size):
    """Every id once, crcs right, sequences gapless and within size."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids, at = want_ids(tok, texts[d]), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    pad = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        total += at
        pad += 0 if at & (at - 1) == 0 else size - at
    return pad / max(1, total)


def test_packing_whole_table(spark, tok):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    assert check_pieces(packing.pack(d).collect(), texts, tok, 2048) < 0.03


def test_packing_odd(spark, tok):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(ODD)], "doc_id long, text string, start long, offset long")
    check_pieces(packing.pack(df, size=64).collect(), dict(enumerate(ODD)), tok, 64)
    assert packing.pack(df.limit(0)).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted((p.doc_id or 0, p.start, p.length) for p in twice) == [(0, 0, 2), (1, 0, 3), (1, 0, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0, 4, 32])), min_size=1, max_size=40))
def test_window_cuts_are_optimal(steps):
    size, ends = 16, np.cumsum([s for s, _ in steps])
    penalty = np.array([p for _, p in steps])
    place = [0, *ends.tolist()]

    def pad(n):
        return packing.SHORT_WINDOW if n in (8, 4, 2) else size - n

    best = [0]
    for j in range(1, len(place)):
        best.append(min(best[i] + min(pad(n), size - n) for i in range(j) if (n := place[j] - place[i]) <= size) + int(penalty[j - 1]))
    cuts = packing.window_cuts(ends, penalty, size)
    got, at = 0, 0
    for c in cuts:
        n = int(ends[c]) - at
        got, at = got + min(pad(n), size - n) + int(penalty[c]), int(ends[c])
    assert cuts[-1] == len(steps) - 1 and got == best[-1]


def test_token_files_round_trip(spark, tok):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(d, path)
    texts = {r.doc_id: r.text for r in d.collect()}
    got = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    at = 0
    for i in sorted(texts):
        ids = want_ids(tok, texts[i])
        assert got[i].ids == ids and got[i].start == at and got[i].n_tokens == len(ids)
        at += len(ids)
    for r in token_files.token_digests(spark, path).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(got[r.doc_id].ids, "<u4").tobytes())
    some = sorted(texts)[17]
    assert token_files.read_document(spark, path, some) == got[some].ids
    assert token_files.read_document(spark, path, -5) is None
    assert token_files.load_dictionary(spark, path)


def test_token_files_odd(spark, tok):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "again", "x"), (None, "no id", "x")]
    path = scratch_path(spark, "test-odd")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string, shard string"), path)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    assert sorted(map(tuple, (r.ids for r in got))) == sorted(tuple(want_ids(tok, t)) for _, t, _ in rows)
    path = scratch_path(spark, "test-none")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_files.token_digests(spark, path).count() == 0


def test_token_files_hot_id(spark, tok):
    rows = [(7, f"text number {k}") for k in range(300)] + [(k, "one two") for k in range(100, 700)] + [(-5, "first")]
    path = scratch_path(spark, "test-hot")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()][:-1]
    assert sorted(tuple(r.ids) for r in got if r.doc_id == 7) == sorted(tuple(want_ids(tok, t)) for d, t in rows if d == 7)

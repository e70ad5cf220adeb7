import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from lexmill.llm import piece_fst

_lib = SentencePieceProcessor(model_file=piece_fst.default_model())
_fst = piece_fst.PieceTransducer(piece_fst.default_model())
ODD = [None, "", " ", "      ", "a" + " " * 40 + "b", "▁x", "x▁▁y", "é́ 中文 \U0001f600", "\n\t\r", "<s></s><unk><0x0A>", "z" * 3000, "supercalifragilistic " * 50, "\x00\x7f", "https://a.b/c?d=e&f=1234567890"]


def test_whole_table_equals_library(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    got = piece_fst.encode(d).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == _lib.encode(texts[r.doc_id]) and r.text == texts[r.doc_id]
    for r in piece_fst.digests(d.where("doc_id < 50")).collect():
        ids = _lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a", "x"), (1, "", "y")], "doc_id long, text string, ids string")
    got = piece_fst.encode(df).collect()
    assert len(got) == len(ODD) + 2 and piece_fst.encode(df.limit(0)).count() == 0
    for r in got:
        t = "a" if r.doc_id is None else ODD[r.doc_id] or ""
        assert r.ids == _lib.encode(t) and r.text == _lib.decode(_lib.encode(t))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdehinorst ▁,.'", max_size=80)))
def test_random_texts_equal_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert _fst.encode(text) == _lib.encode(text)
    assert _fst.decode(_fst.encode(text)) == _lib.decode(_lib.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinrstlo", min_size=1, max_size=14))
def test_shortest_path_is_the_merge_result(word):
    assert [_fst.output[c] for c in _fst.shortest_path(piece_fst.SPACE + word)] == _fst.merge(piece_fst.SPACE + word)

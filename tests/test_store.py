"""Writers are idempotent, charsets decode, the stream replaces its own batches, plans are the ones wanted."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import fusion, lexical, vectors
from lexmill.plans import search
from lexmill.plans.queries import QUERIES
from lexmill.sources import store
from lexmill.streaming.ingest import ingest_stream

DIR = "/root/testdata/sf0.001"


def test_replace_sources(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source string, n int")
    path = str(tmp_path / "t")
    for _ in range(2):
        store.replace_sources(rows, path)
    assert spark.read.parquet(path).count() == 3
    store.replace_sources(spark.createDataFrame([("a", 9)], "source string, n int"), path)
    assert sorted((r.source, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_chunk_ids_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("a", 1, 1), ("b", 1, 1)], "source string, ordinal int, part_no int")
    ids = {(r.source, r.ordinal, r.part_no): r.chunk_id for r in store.chunk_ids(df.repartition(3), "ordinal", "part_no").collect()}
    assert len(set(ids.values())) == 4 and ids["a", 1, 1] < ids["a", 1, 2] < ids["a", 2, 1]
    path = str(tmp_path / "meta")
    store.write_metadata(spark, path, {"model": '"x"', "dim": "64"})
    store.write_metadata(spark, path, {"dim": "65"})
    assert store.read_metadata(spark, path) == {"model": '"x"', "dim": "65"}


def test_chunk_ids_of_a_large_source(spark):
    rows = [("hot" if k % 3 else f"s{k % 7}", (k * 37) % 500, k) for k in range(1500)] + [(None, 1, 0), (None, 2, 0)]
    df = spark.createDataFrame(rows, "source string, ordinal int, part_no int").repartition(5)
    own = {}
    for r in store.chunk_ids(df, "ordinal", "part_no").collect():
        own.setdefault(r.source, []).append((r.chunk_id, r.ordinal, r.part_no))
    assert sum(map(len, own.values())) == len(rows)
    for got in own.values():
        got.sort()
        assert [i & ((1 << 32) - 1) for i, _, _ in got] == list(range(1, len(got) + 1))
        assert [x[1:] for x in got] == sorted(x[1:] for x in got) and len({i >> 32 for i, _, _ in got}) == 1
    assert store.chunk_ids(df.limit(0), "ordinal").count() == 0


def test_latest_takes_whole_rows(spark):
    rows = [("a", 1, "x", None), ("a", 3, "m", "old"), ("a", 3, "z", None), ("a", None, "zz", "none"), (None, None, None, "only"), ("b", 0, "q", "b")]
    df = spark.createDataFrame(rows, "k string, v int, t string, more string")
    got = store.latest(df.repartition(4), ["k"], "v", "t")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 3, "z", None), (None, None, None, "only"), ("b", 0, "q", "b")], key=str)


def test_decode_pages(spark, tmp_path):
    said = "Şişli İğne ığöüç — “x”"
    (tmp_path / "p.htm").write_bytes(said.encode("windows-1254"))
    r = store.decode_pages(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert r.html == said and len(r.sha256) == 64


def test_report(spark, tmp_path):
    store.write_report(spark.range(1), spark.range(3), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/questions")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    pages.where("page_id % 2 = 0").coalesce(1).write.parquet(src)
    ingest_stream(spark, src, out, mark, "*.parquet").awaitTermination(120)
    pages.where("page_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        ingest_stream(spark, src, out, mark, "*.parquet").awaitTermination(120)
    got = spark.read.parquet(out).where("pos is not null").select("page_id", "pos", "tag", "text")
    want = QUERIES["page_blocks"](spark, DIR).select("page_id", "pos", "tag", "text")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_vector_edge_cases(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.6, 0.8]), (5, [float("nan"), 1.0])], "doc_id long, vec array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "qid long, vec array<double>")
    assert sorted((r.qid, r.doc_id, r.sim) for r in vectors.nearest(v, q, 5).collect()) == [(7, 1, 1.0), (7, 4, 0.6)]
    assert [(r.doc_id, r.sim) for r in vectors.nearest(v.coalesce(1), q, 1).collect()] == [(1, 1.0)]
    assert vectors.nearest(v, q.limit(0), 5).count() == 0
    pairs = spark.createDataFrame([(7, 4), (7, 2), (8, 1), (9, 99)], "qid long, doc_id long")
    assert {(r.qid, r.doc_id): r.sim for r in vectors.pair_similarities(pairs, v, q).collect()} == {(7, 4): 0.6, (7, 2): 0.0, (8, 1): 0.0, (9, 99): 0.0}
    short = spark.createDataFrame([(7, [1.0]), (8, [0.0, 3.0])], "qid long, vec array<double>")
    both = v.unionByName(spark.createDataFrame([(9, [-2.0]), (10, [1.0, None])], "doc_id long, vec array<double>"))
    assert sorted(map(tuple, vectors.nearest(both, short, 5).collect())) == [(7, 9, -1.0), (8, 1, 0.0), (8, 4, 0.8)]  # each meets its own length
    with pytest.raises(Exception, match="length"):
        vectors.nearest(v, short.limit(1), 5, strict=True).collect()


def test_nearest_against_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 8)), 1)
    x[100:140] = x[0]  # ties
    v = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "doc_id long, vec array<double>").repartition(3)
    q = v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sims = np.round(u[::20] @ u.T, 6)
    want = sorted((20 * i, int(j), float(sims[i, j])) for i in range(len(sims)) for j in np.lexsort((np.arange(600), -sims[i]))[:7])
    for most, size in ((8 << 20, 64 << 20), (50, 400)):  # the second: many scans, small steps
        monkeypatch.setattr(vectors, "MOST_SIMS", most)
        monkeypatch.setattr(vectors, "QUERY_BYTES", size)
        got = lexical.top(vectors.nearest(v, q, 7), 7, "sim")
        assert sorted((r.qid, r.doc_id, r.sim) for r in got.collect()) == want
    best = vectors._Best(2, 3)
    best.limit = 4
    for s in range(0, 600, 50):
        best.add(np.arange(s, s + 50), sims[:2, s : s + 50].T)
    query, ids, found = best.settle()
    assert sorted(zip(query.tolist(), ids.tolist())) == sorted((i, int(j)) for i in range(2) for j in np.lexsort((np.arange(600), -sims[i]))[:3])


def test_vector_search_memory_is_bounded(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(vectors, "MOST_VALUES", 100)
    batch = pa.record_batch([pa.array(range(30)), pa.array([None if k == 4 else [float(k)] * 40 for k in range(30)])], ["doc_id", "vec"])
    parts = list(vectors._parts(batch.slice(2)))
    assert pa.Table.from_batches(parts).to_pylist() == batch.slice(2).to_pylist() and max(len(x.column(1).flatten()) for x in parts) <= 120
    assert list(vectors._parts(batch.slice(0, 0))) == []
    v = spark.createDataFrame([(k, [1.0, k / 50]) for k in range(60)], "doc_id long, vec array<double>")
    q = v.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "qid")
    want = sorted(map(tuple, lexical.top(vectors.nearest(v, q, 3), 3, "sim").collect()))
    monkeypatch.setattr(vectors, "MOST_BEST", 6)  # two queries a scan
    parted = vectors.nearest(v, q, 3)
    assert parted._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 3
    assert sorted(map(tuple, lexical.top(parted, 3, "sim").collect())) == want


def test_labelled_results_are_found_once(spark):
    from lexmill.plans import queries

    best, _ = queries._labelled_results(spark, DIR)
    assert "MapInArrow" not in best._jdf.queryExecution().analyzed().toString()


def test_every_row_is_a_question(spark):
    asked = spark.read.parquet(f"{DIR}/embeddings.parquet").count()
    got = QUERIES["eval_summary"](spark, DIR).first()
    assert got.n == asked and 0 < got.missed < asked


def test_neighbours_of_every_row(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(700, 8)), 1)
    x[100:180] = x[0]  # ties
    label = [None if i % 50 == 0 else i % 3 for i in range(700)]
    rows = [(i, list(map(float, r)), label[i]) for i, r in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] + [1.0] * 7, 1), (1003, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (1004, [1.0, 0.0], 1), (1005, [1.0, 1.0], 2)]
    v = spark.createDataFrame(rows, "doc_id long, vec array<double>, label int").repartition(3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sims = np.round(u @ u.T, 6)
    np.fill_diagonal(sims, -3.0)
    same = lambda i, j: None if label[i] is None or label[j] is None else label[i] == label[j]
    want = {(i, int(j), float(sims[i, j]), same(i, j)) for i in range(700) for j in np.lexsort((np.arange(700), -sims[i]))[:4]}
    want |= {(1004, 1005, 0.707107, False), (1005, 1004, 0.707107, False)}
    for values, least in ((1 << 22, 1024), (600, 1024), (1 << 22, 100)):  # one block, ten, eight
        monkeypatch.setattr(vectors, "BLOCK_VALUES", values)
        monkeypatch.setattr(vectors, "LEAST_ROWS", least)
        got = lexical.top(vectors.neighbours(v, 4), 4, "sim").select("qid", "doc_id", "sim", "same").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert vectors.neighbours(v.limit(0), 4).count() == 0
    monkeypatch.setattr(vectors, "TILE_ROWS", 64)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 16)
    a, b = np.arange(0, 700, 2), np.arange(1, 700, 2)
    for k, first, second, ids in ((4, a, b, None), (90, a, b, None), (4, a, a, np.arange(700))):  # 90: more than a tile has
        apart = np.round(u[first] @ u[second].T, 6) - (0 if ids is None else 4 * np.eye(len(first)))
        back, there = ({(int(q[i]), int(r[j]), float(s[i, j])) for i in range(len(q)) for j in np.lexsort((r, -s[i]))[:k]} for q, r, s in ((first, second, apart), (second, first, apart.T)))
        one, other = ({(int(q), int(r), float(s)) for q, r, s in zip(*part)} for part in vectors._compared((first, u[first]), (second, u[second]), ids, k))
        assert other == there and one == (back if ids is None else set())
    many = vectors._Nearest(16, 4)
    for r in range(0, 6400, 64):  # copies: rows that only tie are not kept
        many.tile(np.ones((64, 16)), 0, r, 0)
    assert many.waiting == 64 * 16 and sorted(set(many.settle()[1].tolist())) == [0, 1, 2, 3]


def test_fusion_rules(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "qid long, doc_id long, rank int")
    fused = fusion.fuse({"vector": (ranked([(1, 10, 1), (1, 11, 2)]), 1.0), "lexical": (ranked([(1, 12, 1), (1, 11, 2)]), 1.0), "number": (ranked([(1, 13, 1)]), 0.0)})
    top = fusion.top_fused(fused, 4).orderBy("rank").collect()
    assert [(r.doc_id, r.sources) for r in top] == [(11, ["lexical", "vector"]), (10, ["vector"]), (12, ["lexical"]), (13, ["number"])]
    assert top[-1].score == 0
    rows = [(1, 1, 1, 0.9, 0.9, ["vector"]), (1, 2, 2, 0.5, 0.9, ["vector"]), (2, 1, 1, 0.9, 0.9, ["vector"]), (2, 2, 2, 0.2, 0.9, ["number"]), (3, 1, 1, 0.0, 0.0, ["lexical"]), (4, 1, 1, 0.9, 0.9, ["vector"]), (4, 2, 2, 0.7, 0.9, ["vector"]), (4, 3, 3, 0.1, 0.9, ["lexical"])]
    df = spark.createDataFrame(rows, "qid long, doc_id long, rank int, sim double, max_sim double, sources array<string>")
    got = {(r.qid, r.doc_id): r.in_context for r in fusion.context_filter(df).collect()}
    assert got == {(1, 1): True, (1, 2): True, (2, 1): False, (2, 2): True, (3, 1): True, (4, 1): True, (4, 2): True, (4, 3): False}


def test_rare_terms_when_all_are_frequent(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 2} all") for i in range(10)], "doc_id long, content string")
    post = lexical.tokens(docs, F.col("content"))
    asked = spark.createDataFrame([(1, "common all word0 absent")], "qid long, text string")
    wanted = lexical.terms(asked)
    df = lexical.document_frequency(lexical.term_documents(post, wanted), wanted)
    assert {r.term: r.df for r in df.collect()} == {"commo*": 10, "all*": 10, "word0*": 5, "absen*": 0}
    assert [r.term for r in lexical.selective_terms(wanted, df, 10).orderBy("place").collect()] == ["commo*", "all*", "word0*"]


def test_plans(spark):
    plan = QUERIES["normalize_text"](spark, DIR)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
    plan = QUERIES["chunk_documents"](spark, DIR)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
    lex = lexical.matches(search.index_of(spark, DIR).vocabulary, lexical.terms(search.questions(spark, DIR)))
    assert "NestedLoop" not in lex._jdf.queryExecution().toString() and "Cartesian" not in lex._jdf.queryExecution().toString()


def test_missing_numbers_across_buckets(spark, monkeypatch):
    from lexmill.operators import evaluation

    monkeypatch.setattr(evaluation, "NUMBER_BUCKET", 8)
    rows = [("a", n) for n in (2, 3, 7, 8, 40, 41)] + [("b", 1), ("b", 1), ("c", 17), ("d", None), ("d", -3)]
    got = evaluation.missing_numbers(spark.createDataFrame(rows, "grp string, n long"), "n", "grp").collect()
    want = {("a", n) for n in range(1, 41) if n not in (2, 3, 7, 8, 40)} | {("c", n) for n in range(1, 17)}
    assert sorted((r.grp, r.number) for r in got) == sorted(want)


def test_stored_index(spark, tmp_path, monkeypatch):
    from lexmill.operators import postings

    docs = search.corpus(spark, DIR)
    postings.write_index(docs, search.search_text(), str(tmp_path / "i"), parts=16)
    index = postings.read_index(spark, str(tmp_path / "i"))
    tokens = lexical.tokens(docs, search.search_text())
    sizes = tokens.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("t")).first()
    assert index.n_docs == sizes.n and index.average == sizes.t / sizes.n and index.vocabulary.count() == index.vocabulary.select("token").distinct().count()
    one = spark.createDataFrame([(1, "the zqx 17 idiot"), (2, ""), (3, None)], "qid long, text string")
    for asked in (one, search.questions(spark, DIR)):
        wanted = lexical.terms(asked)
        got = {tuple(r) for r in postings.term_documents(index, wanted).select("term", "doc_id", "tf", "n_tokens").collect()}
        assert got == {tuple(r) for r in lexical.term_documents(tokens, wanted).select("term", "doc_id", "tf", "n_tokens").collect()} and got
    # few tokens: only their folders are opened
    met = lexical.matches(index.vocabulary, lexical.terms(spark.createDataFrame([(1, "17")], "qid long, text string")))
    plan = postings.postings_of(index, met)._jdf.queryExecution().toString()
    assert "part#" in plan.split("PartitionFilters:")[1].split("]")[0]
    # many kept terms are dealt by shares of the documents, with the same scores
    wanted = lexical.terms(search.questions(spark, DIR))
    found = postings.term_documents(index, wanted, (0.12,))
    kept = lexical.selective_terms(wanted, lexical.document_frequency(found, wanted), index.n_docs)
    want = sorted(map(tuple, lexical.bm25(kept, found, index.n_docs, index.average).collect()))
    monkeypatch.setattr(lexical, "MOST_MATCHES", 0)
    assert sorted(map(tuple, lexical.bm25(kept, found, index.n_docs, index.average).collect())) == want and want


@pytest.mark.parametrize("again", [False, True])
def test_frequencies_from_the_vocabulary(spark, tmp_path, again):
    from lexmill.operators import postings

    rows = [(1, "alpha alphabet one  one"), (2, "alpha two"), (3, None), (4, ""), (5, "alphorn beta")] + [(2, "alphabet two two"), (None, "beta")] * again
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    postings.write_index(docs, F.coalesce("text", F.lit("")), str(tmp_path / "i"), parts=4)
    index = postings.read_index(spark, str(tmp_path / "i"))
    assert index.unique is not again and (index.n_docs, index.average) == ((4 + 1, 12 / 5) if again else (5, 8 / 5))
    wanted = lexical.terms(spark.createDataFrame([(1, "alphas beta two absent"), (2, "one two")], "qid long, text string"))
    want = {r.term: r.df for r in lexical.document_frequency(postings.term_documents(index, wanted), wanted).collect()}
    assert {r.term: r.df for r in postings.document_frequency(index, wanted).collect()} == want
    assert want["two*"] == 1 and want["beta*"] == 1 + again and want["absen*"] == 0
    found = {(r.term, r.doc_id): (r.tf, r.n_tokens) for r in postings.term_documents(index, wanted).collect()}
    assert found["one*", 1] == (2, 4) and found["two*", 2] == ((3, 3) if again else (1, 2))


def test_the_index_is_built_without_a_shuffle_of_words(spark, tmp_path):
    from lexmill.operators import postings

    docs = spark.createDataFrame([(k, f"word{k % 5} common " * 50) for k in range(400)], "doc_id long, text string").repartition(2)
    postings.write_index(docs, F.col("text"), str(tmp_path / "i"), parts=2)
    files = spark.read.parquet(str(tmp_path / "i" / "postings")).inputFiles()
    assert len(files) <= 2 * 2  # a file a task and part: as the texts were dealt
    assert spark.read.parquet(str(tmp_path / "i" / "postings")).where("token = 'common'").agg(F.sum("tf")).first()[0] == 20_000


def test_postings_of_frequent_terms_stay_unread(spark):
    from lexmill.operators import postings

    known = spark.createDataFrame([("all*", "all", 90), ("all*", "alloy", 2), ("rare*", "rare", 3), ("mid*", "middle", 8), ("mid*", "midst", 7)], "term string, token string, df long")
    wanted = spark.createDataFrame([(1, "all*"), (1, "rare*"), (2, "all*"), (2, "mid*"), (3, "mid*")], "qid long, term string")
    need = lambda *limits: sorted(r.term for r in postings.needed_terms(known, wanted, 100, limits).collect())
    assert need(0.12) == ["all*", "mid*", "rare*"]  # query 2 may lack a selective term
    assert need(0.2) == ["mid*", "rare*"] and need(0.02, 0.2) == ["all*", "mid*", "rare*"] and need(0.95) == ["all*", "mid*", "rare*"]


def test_an_index_that_was_cleared_is_made_again(spark):
    import shutil

    first = search.index_of(spark, DIR)
    path = next(v for k, v in search._indexes.items() if k[1] == DIR)
    assert search.index_of(spark, DIR).n_docs == first.n_docs and path in search._indexes.values()
    shutil.rmtree(path.removeprefix("file:").replace("//", "/"))
    assert search.index_of(spark, DIR).vocabulary.count() > 0 and path not in search._indexes.values()


def test_documents_are_scored_where_they_are_read(spark, monkeypatch):
    from lexmill.operators import postings, ranking

    texts, index, asked = search.texts_of(spark, DIR), search.index_of(spark, DIR), search.questions(spark, DIR)
    variants = [(1.0, False), (0.12, True)]
    scored = search.lexical_channels(texts, asked, variants, 5)
    plan = scored._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan  # no (question, document) row and no posting is shuffled
    best = lambda rows: sorted(map(tuple, lexical.top(rows, 5, by=("variant", "qid")).select("variant", "qid", "doc_id", "score", "rank").collect()))
    want = best(search.lexical_channels(index, asked, variants, 5))
    assert best(scored) == want and len({r[0] for r in want}) == 2
    wanted = lexical.terms(asked)
    same = lambda df: {r.term: r.df for r in df.collect()}
    counted, average = ranking.term_frequencies(texts, wanted)
    assert same(counted) == same(postings.document_frequency(index, wanted)) and average == index.average and texts.n_docs == index.n_docs
    # more questions and terms than one scan takes
    monkeypatch.setattr(ranking, "MOST_KEPT", 200)
    monkeypatch.setattr(ranking, "MOST_TERMS", 100)
    parted = search.lexical_channels(texts, asked, variants, 5)
    assert parted._jdf.queryExecution().analyzed().toString().count("MapInArrow") > 2 and best(parted) == want
    assert same(ranking.term_frequencies(texts, wanted)[0]) == same(counted)
    none = spark.createDataFrame([(1, ""), (2, None), (3, "zzzzqq")], "qid long, text string")
    assert search.lexical_channel(texts, none, 5).count() == 0


def test_scoring_works_in_bounded_pieces(spark, monkeypatch):
    import pyarrow as pa
    from lexmill.operators import ranking

    words = ["alpha one one", "", None, "alpha alphabet two", "one", "three", "alphorn " * 30, "alpha"]
    batch = pa.record_batch([pa.array(range(len(words)), pa.int64()), pa.array(words)], ["doc_id", "text"])
    row, term, tf = ranking.Matcher(pa.array(["alph*", "alphab*", "one", "on"])).counts(*next(ranking.word_pieces(batch))[2:])
    assert list(zip(row.tolist(), term.tolist(), tf.tolist())) == [(0, 0, 1), (0, 2, 2), (3, 0, 2), (3, 1, 1), (4, 2, 1), (6, 0, 30), (7, 0, 1)]
    runs, peaks = [], []
    monkeypatch.setattr(ranking, "arrow_map", lambda rows, run, schema: runs.append(run))
    kept = pa.table({"qid": [7, 7, 9, 8], "term": ["alph*", "one", "one", "absent"], "weight": [1.0, 2.0, 3.0, 1.0]})
    ranking._scored(ranking.Texts(None, 8), kept, 5.0, 2, [("qid", "bigint")], ranking.DEFAULT)
    rows = lambda: [tuple(r.values()) for b in runs[0](iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    want = rows()
    add = ranking._Best.add
    monkeypatch.setattr(ranking._Best, "add", lambda self, ids, sims: (peaks.append(sims.size), add(self, ids, sims)))
    monkeypatch.setattr(ranking, "PIECE_BYTES", 20)
    monkeypatch.setattr(ranking, "MOST_CELLS", 9)
    assert rows() == want and [r[:2] for r in want] == [(7, 0), (7, 4), (9, 0), (9, 4)] and max(peaks) <= 12


def test_documents_with_one_id_are_scored_together(spark, tmp_path):
    from lexmill.operators import postings

    rows = [(1, "alpha one", "s"), (1, "alpha two", "s"), (2, "alpha", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    source = search.texts_of(spark, str(tmp_path))
    assert isinstance(source, postings.Index)
    asked = spark.createDataFrame([(1, "two")], "qid long, text string")
    assert [(r.qid, r.doc_id) for r in search.lexical_channel(source, asked, 5).collect()] == [(1, 1)]


def test_texts_that_were_cleared_are_made_again(spark):
    import shutil

    first = search.texts_of(spark, DIR)
    path = next(v for k, v in search._texts.items() if k[1] == DIR)
    shutil.rmtree(path.removeprefix("file:").replace("//", "/"))
    assert search.texts_of(spark, DIR).n_docs == first.n_docs and path not in search._texts.values()


def test_only_vectors_of_pairs_leave_the_scan(spark, monkeypatch):
    v = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(40)] + [(40, None)], "doc_id long, vec array<double>")
    q = v.where("doc_id in (0, 7)").withColumnRenamed("doc_id", "qid")
    pairs = spark.createDataFrame([(0, 3), (7, 7), (7, 40), (7, 99), (5, 3)], "qid long, doc_id long")
    out = vectors.pair_similarities(pairs, v, q)
    plan = out._jdf.queryExecution().toString()
    assert "LeftSemi, BuildRight" in plan
    want = sorted((r.qid, r.doc_id, r.sim) for r in out.collect())
    assert [w[:2] for w in want] == [(0, 3), (5, 3), (7, 7), (7, 40), (7, 99)] and [w[2] for w in want] == [0.316228, 0, 1.0, 0, 0]
    monkeypatch.setattr(vectors, "MOST_PAIRS", 1)
    assert sorted((r.qid, r.doc_id, r.sim) for r in vectors.pair_similarities(pairs, v, q).collect()) == want


def test_texts_of_the_context_stay_where_they_are(spark):
    from lexmill.plans import queries

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # tables of any size
    try:
        plan = queries._with_context(spark, DIR)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin [doc_id" in plan and "SortMergeJoin [doc_id" not in plan


def _built(monkeypatch, name, spark):
    """How often a query writes an index, stores the texts, and scans them."""
    from lexmill.operators import postings, ranking

    calls = {"write_index": 0, "_frequencies": 0, "_scored": 0}

    def counting(module, f):
        real = getattr(module, f)

        def run(*args):
            calls[f] += 1
            return real(*args)

        monkeypatch.setattr(module, f, run)

    counting(postings, "write_index"), counting(ranking, "_frequencies"), counting(ranking, "_scored")
    monkeypatch.setattr(search, "_indexes", {})
    QUERIES[name](spark, DIR)
    return calls


@pytest.mark.parametrize("name", ["bm25_search", "rrf_fusion"])
def test_a_search_needs_no_postings(spark, monkeypatch, name):
    assert _built(monkeypatch, name, spark) == {"write_index": 0, "_frequencies": 1, "_scored": 1}


def test_the_grid_scans_the_texts_once_for_all_variants(spark, monkeypatch):
    assert _built(monkeypatch, "tuning_grid", spark) == {"write_index": 0, "_frequencies": 1, "_scored": 1}


def test_texts_are_normalised_where_they_are_stored(spark, tmp_path, monkeypatch):
    from lexmill.operators import ranking

    monkeypatch.setattr(ranking, "PIECE_BYTES", 8)
    docs = spark.createDataFrame([(1, "Ärger, İŞ  yeri!"), (2, None), (3, "x́--7"), (4, "")], "doc_id long, text string")
    ranking.write_texts(docs, F.col("text"), str(tmp_path / "t"))
    texts = ranking.read_texts(spark, str(tmp_path / "t"))
    assert {r.doc_id: r.text for r in texts.rows.collect()} == {1: "arger is yeri", 2: "", 3: "x 7", 4: ""} and texts.n_docs == 4
    stored = search.texts_of(spark, DIR).rows.withColumnRenamed("text", "stored")
    both = stored.join(search.corpus(spark, DIR).select("doc_id", lexical.words(search.search_text()).alias("want")), "doc_id")
    assert both.count() == stored.count() == both.where(lexical.words(F.col("stored")) == F.col("want")).count()  # all three fields


@pytest.mark.parametrize("name", ["rrf_fusion", "tuning_grid"])
def test_no_regular_expression_runs_over_the_texts(spark, monkeypatch, name):
    from lexmill.operators import ranking

    plans, real = [], ranking.write_texts
    monkeypatch.setattr(ranking, "write_texts", lambda docs, text, *rest: (plans.append(docs.select(text)._jdf.queryExecution().toString()), real(docs, text, *rest)))
    monkeypatch.setattr(search, "_texts", {})
    QUERIES[name](spark, DIR)
    assert len(plans) == 1 and "regexp_replace" not in plans[0] and "translate" not in plans[0]

import heapq

import numpy as np
import pytest

from lexmill.llm import vector_dedup
from lexmill.llm.graph import min_labels


def brute(ids, x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    order = np.argsort(ids)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    lab = min_labels(len(ids), back[i], back[j])
    return {int(ids[k]): (int(near[k].sum()), int(ids[order[lab[back[k]]]])) for k in range(len(ids))}


def test_whole_table_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    got = {r.vec_id: r for r in vector_dedup.vector_components(df).collect()}
    assert set(got) == set(want)
    links = sum(n for n, _ in want.values())
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.97 * links
    assert sum(got[i].component_id == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_crowded_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    x = np.vstack([centre + 0.05 * rng.normal(size=(400, 16)), rng.normal(size=(300, 16))])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    want = brute(ids, x)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.vector_components(df).collect()}
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_blocks_meet_parts_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centre = rng.normal(size=8)
    x = np.vstack([centre + 0.1 * rng.normal(size=(150, 8)), rng.normal(size=(100, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = vector_dedup.vector_components(df).collect()
    for block, part in ((32, 16), (1024, 8), (16, 1024)):
        monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", block)
        monkeypatch.setattr(vector_dedup, "PROBE_ROWS", part)
        assert sorted(vector_dedup.vector_components(df).collect()) == sorted(want)
    found = brute(np.arange(len(x)), x)
    assert sum(r.n_links for r in want) >= 0.97 * sum(n for n, _ in found.values()) > 1000


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.0, -1.0]), (11, [0.0, -1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_components(df).collect())
    alone = [(i, 0, i, True) for i in range(4, 11)]  # 10 has a length of its own
    assert got == [(0, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), *alone, (11, 1, 11, True), (11, 1, 11, True)]
    assert vector_dedup.vector_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 7, 30, 200])
def test_multi_sequence(n):
    rng = np.random.default_rng(n)
    a, b = rng.random(9), rng.random(13)
    want = heapq.nsmallest(n, [x + y for x in a for y in b])
    got = vector_dedup.multi_sequence(a, b, n)
    assert np.allclose([a[i] + b[j] for i, j in got], want) and len(set(got)) == len(got)


def test_every_length_links(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for dim, n in ((4, 40), (2, 2), (8, 30)):
        centres = rng.normal(size=(n, dim))
        for c in centres:
            for scale in (1.0, 3.0):
                rows.append((at, (scale * c).tolist()))
                at += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.vector_components(df).collect()}
    for dim in (2, 4, 8):
        own = [r for r in rows if len(r[1]) == dim]
        want = brute(np.array([i for i, _ in own]), np.array([v for _, v in own]))
        assert {i: got[i] for i, _ in own} == want


def test_rare_lengths_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "FITTED_LENGTHS", 1)
    rows = [(k, [1.0, float(k)]) for k in range(6)] + [(10 + k, [1.0, 0.01 * k, 0.0]) for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.vector_components(df).collect()}
    assert all(got[10 + k] == (3, 10) for k in range(4))


def test_traversal_grows_until_the_target(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = vector_dedup._at_limit(x, 0.95)
    assert np.allclose((near * x).sum(1), 0.95) and np.allclose(np.linalg.norm(near, axis=1), 1)
    both = np.vstack([x, near])
    monkeypatch.setattr(vector_dedup, "LEAST_WORDS", 16)
    for sample in (both, x):  # with links of its own, and with partners made up at the limit
        index = vector_dedup.fit(sample, len(sample))
        assert index.probes > 1
        fresh = vector_dedup._at_limit(x, 0.95)
        home = index.cells(x, 1)[:, 0]
        assert (index.cells(fresh) == home[:, None]).any(1).mean() >= 0.97
    whole = vector_dedup.fit(both, len(both), target=1.0)
    assert whole.probes <= 256


def test_ranks_are_places_in_the_traversal():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 10))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = vector_dedup.MultiIndex(rng.normal(size=(7, 5)), rng.normal(size=(9, 5)), 1)
    order = index.cells(x, 63)
    at = rng.integers(0, 90, 200)
    place = rng.integers(0, 63, 200)
    assert (index.ranks(x, at, order[at, place]) == place).all()


def test_hot_equal_vectors_and_useless_ones(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "HOT_ROWS", 20)
    rng = np.random.default_rng(4)
    same, other = rng.normal(size=6), rng.normal(size=6)
    rows = [(k, same.tolist()) for k in range(300)] + [(300 + k, (2 * same).tolist()) for k in range(5)]
    rows += [(400 + k, other.tolist()) for k in range(15)] + [(500 + k, v) for k, v in enumerate([None, [0.0] * 6] * 100)]
    rows += [(None, same.tolist()), (None, (-same).tolist()), (None, (-same).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = [tuple(r) for r in vector_dedup.vector_components(df).collect()]
    want = [(k, 305, 0, k == 0) for k in range(305)] + [(400 + k, 14, 400, k == 0) for k in range(15)]
    want += [(500 + k, 0, 500 + k, True) for k in range(200)] + [(None, 305, 0, False)] + [(None, 0, None, True)] * 2
    assert sorted(got, key=repr) == sorted(want, key=repr)

import numpy as np
import xxhash

from lexmill.llm import simhash
from lexmill.llm.graph import connected_components, min_labels


def slow_fingerprint(text, words=4):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius=4):
    ids, f = np.array([x for x, _ in fps]), np.array([y for _, y in fps], np.uint64)
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    order = np.argsort(ids, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    lab = min_labels(len(ids), back[i], back[j])
    return {int(ids[k]): int(ids[order[lab[back[k]]]]) for k in range(len(ids))}


def similar_groups(texts, least, words=5):
    """The smallest ids of the groups that shingle similarity of ``least`` or more connects, by brute force."""
    sets, holders = {}, {}
    for i, t in sorted(texts.items()):
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    ids = sorted(texts)
    at = {i: k for k, i in enumerate(ids)}
    pairs = {(a, b) for own in holders.values() for n, a in enumerate(own) for b in own[n + 1 :]}
    near = [(at[a], at[b]) for a, b in pairs if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    lab = min_labels(len(ids), np.array([x for x, _ in near], int), np.array([y for _, y in near], int))
    return [i for k, i in enumerate(ids) if lab[k] == k]


def kept_ids(found):
    return sorted({r.doc_id for r in found if r.doc_id == r.component_id})


def test_similar_components(spark):
    """At 0.8 the groups are those of the shingle sets, no estimate's error either way."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert kept_ids(simhash.similar_components(d).collect()) == similar_groups({r.doc_id: r.text for r in d.collect()}, 0.8)


def test_pairs_at_the_limit(spark):
    """Isolated pairs just above 0.8 are found (0.98 or more of them), those just below never joined."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(400):
        w = [f"p{k}w{j}" for j in range(int(rng.integers(100, 400)))]
        n = len(w) - 4  # shingles; dropping the last x words leaves n - x of them
        drop = int(n * 0.2) if k % 2 else int(n * 0.2) + 1
        want[k] = (n - drop) / n >= 0.8
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: len(w) - drop]))]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = {k: got[2 * k + 1] == 2 * k for k in want}
    assert not any(joined[k] for k in want if not want[k])
    assert sum(joined[k] for k in want if want[k]) >= 0.98 * sum(want.values())


def test_doubtful_crowds_in_blocks(spark, monkeypatch):
    """A crowd whose pairs lie on both sides of the limit, verified some rows at a time, is grouped as by brute force."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 32)
    monkeypatch.setattr(simhash, "SET_ROWS", 16)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(3):
        base = [f"c{c}w{k}" for k in range(200)]
        for i in range(70):
            w = list(base)
            for at in rng.choice(200, int(rng.integers(1, 9)), replace=False):
                w[at] = f"new{c}x{i}x{at}"
            rows.append((1000 * c + i, " ".join(w)))
    found = simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert kept_ids(found) == similar_groups(dict(rows), 0.8)


def test_pivots_from_the_bucket_discard():
    """In a bucket of several crowds the distances to its own rows discard more than half of the pairs between crowds."""
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, (8, simhash.LONG_WORDS), dtype=np.uint64)
    fp = np.concatenate([np.tile(c, (60, 1)) for c in centres])
    for r in fp:
        for b in rng.choice(64 * simhash.LONG_WORDS, 60, replace=False):
            r[b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
    pivots = fp[::60]
    table = np.column_stack([simhash.distance(fp, p) for p in pivots])
    i, j = np.triu_indices(len(fp), 1)
    apart = i // 60 != j // 60
    assert (np.abs(table[i] - table[j]).max(axis=1) > 205)[apart].mean() > 0.99
    u, v, d = simhash._block_links(fp, np.arange(len(fp)), np.arange(len(fp)), 130, 205)
    assert len(simhash.spanning_links(len(fp), u, v)[0]) == len(fp) - 8 and set(d) == {0}


def test_near_copies_in_crowds(spark, monkeypatch):
    """A crowd of near copies of one text, dealt in blocks, is one group; unlike texts are their own."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        w[int(rng.integers(0, 300))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.integers(0, 10**6)}" for _ in range(80))) for i in range(100)]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 + i for i in range(100))


def test_repeats_of_a_line_count_once(spark):
    """A line that two unlike texts repeat does not link them; how often the same text repeats a line does not part it."""
    own = [" ".join(f"d{k}w{j}" for j in range(100)) for k in range(3)]
    line = " ".join(f"line{j}" for j in range(10))
    rows = [(k, " ".join([line] * 10) + " " + own[k]) for k in range(2)] + [(2, " ".join([line] * 2) + " " + own[2]), (3, " ".join([line] * 12) + " " + own[2])]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def test_keep_one_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "One TWO"), (None, "one two"), (5, "else"), (5, "quite another"), (None, "lone"), (None, "lone")]
    df = spark.createDataFrame([(i, t, "x", i, "y") for i, t in rows], "doc_id long, text string, component_id string, place long, row string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, "lone"), (1, ""), (3, "one two"), (5, "else"), (5, "quite another")]
    assert all(r.component_id == "x" and r.place == r.doc_id and r.row == "y" for r in got.collect())
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in d.select("doc_id", "text").collect()]
    want = slow_components(rows)
    got = simhash.simhash_components(d).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in rows}
    assert {r.doc_id: r.component_id for r in got} == want


def test_dense_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = []
    for k in range(1500):
        f = int(centres[k % 4])
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            f ^= 1 << int(b)
        fps.append((k * 7 % 1500, f))
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in fps], "doc_id long, fp long")
    comp = {r.fp: r.component for r in simhash.fingerprint_components(df).collect()}
    want = slow_components(fps)
    assert all(comp[int(np.uint64(f).astype(np.int64))] == want[i] for i, f in fps)


def test_null_id_is_a_bridge(spark):
    fps = spark.createDataFrame([(1, 0), (None, 0xF), (2, 0xFF), (None, 0xFFFFF << 40)], "doc_id long, fp long")
    assert {r.fp: r.component for r in simhash.fingerprint_components(fps).collect()} == {0: 1, 0xF: 1, 0xFF: 1, 0xFFFFF << 40: None}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "a b c d e"), (5, "A b C d e"), (6, "ÄÖ b c")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp long")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect())
    want = sorted((i or 0, f"{slow_fingerprint(t):016x}", {1: 1, 2: 1, 3: 1, 4: 4, None: 5, 5: 5, 6: 6}[i]) for i, t in rows)
    assert got == want
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    """Hubs, whose minima are broadcast, in the middle and at either end of the ids."""
    from lexmill.llm import graph

    monkeypatch.setattr(graph, "HOT_ROWS", 8)
    edges = [(500, k) for k in range(100, 200)] + [(1, k) for k in range(1000, 1100)] + [(9999, k) for k in range(2000, 2100)] + [(1050, 9999)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 100 for k in [500, *range(100, 200)]} | {k: 1 for k in [1, 9999, *range(1000, 1100), *range(2000, 2100)]}
    assert got == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)}


def test_components_with_few_edges(spark):
    """Plain and counted joins give the same components, hubs included."""
    from lexmill.llm.graph import connected_components

    edges = [(1000, k) for k in range(1, 700)] + [(k, k + 1) for k in range(2000, 2020)] + [(5, 5), (None, 7), (1000, 3), (3, 1000)]
    df = spark.createDataFrame(edges, "u long, v long")
    one, two = (sorted(map(tuple, connected_components(df, few).collect())) for few in (0, 1_000_000))
    assert one == two and dict(one)[1000] == 1 and dict(one)[2020] == 2000 and len(one) == 700 + 21

"""SimHash near-duplicates: fingerprints, pivot distance tables, exact links and their components.

A fingerprint's links are found in three steps. Pigeonhole buckets bring together all pairs that can be within the
radius (with b segments and r differing bits, at least b - r segments agree). Inside a bucket, precomputed Hamming
distances to the reference fingerprints discard a pair if any coordinate differs by more than the radius (triangle
inequality). Survivors are verified on the fingerprints. Only spanning links leave a task, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.graph import connected_components, hot_limit, join_counted, min_labels, spanning_links
from lexmill.sources.tables import arrow_map, materialize

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
PIVOTS = 16
#: Rows of one bucket that meet in one task; larger buckets are dealt into blocks, and blocks meet in pairs.
BLOCK_ROWS = 2048
#: Large keys that may be broadcast (12 bytes each).
LARGE_KEYS = 1_000_000
#: Near-duplicates by similarity: words a shingle, the least similarity, 64-bit words a fingerprint, bits a key and tables.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
LONG_WORDS, KEY_BITS, TABLES = 16, 14, 44
#: Pairs are linked by their estimate if it is so many standard errors inside the limit, and left if so many beyond it.
SURE_ERRORS, WIDE_ERRORS = 4.0, 4.5
#: Pairs whose first words differ in more bits than this (5 standard errors beyond the widest limit) are not looked at further.
FIRST_WORDS, FIRST_RADIUS = 4, 80
#: Rows of a doubtful group, with their shingle sets, that meet in one task.
SET_ROWS = 1024
_SMALL = 48


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a text of fewer words is one shingle, one without words none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        joined = b" ".join(w)
        ends = np.cumsum([len(x) + 1 for x in w])
        starts = (ends - [len(x) + 1 for x in w])[: len(w) - words + 1].tolist()
        shingles = [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))


def _majority(h: np.ndarray) -> np.ndarray:
    """Per bit of the columns of h whether it is set in over half of the rows, packed into as many words."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for k in range(0, len(h), 1024):
        bits = np.unpackbits(h[k : k + 1024].astype("<u8").view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text; 0 if it has no word."""
    return int(_majority(shingle_hashes(text, words)[:, None])[0])


def long_fingerprint(text: str | None, words: int, size: int = LONG_WORDS) -> np.ndarray:
    """``size`` words of 64 bits, each the majority over an own mix of the distinct shingles' hashes."""
    h = np.unique(shingle_hashes(text, words))[:, None] + np.arange(1, size + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return _majority(h ^ h >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as signed long; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(arrow_map, run, "doc_id long, fp long")


def reference_fingerprints(n: int = PIVOTS, size: int = 1) -> np.ndarray:
    """n fixed references of ``size`` words by the SplitMix64 rule."""
    out, mask = [], (1 << 64) - 1
    for k in range(1, n * size + 1):
        z = k * 0x9E3779B97F4A7C15 & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        out.append(z ^ z >> 31)
    return np.array(out, np.uint64).reshape(n, size)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance along the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.column_stack([distance(fp, p) for p in pivots])


def _pairs_apart(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs survive the pivot test and are within the radius."""
    near = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= radius
    near[near] = distance(fp[i[near]], fp[j[near]]) <= radius
    return near


def _links_small(group: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs within small groups: rows of a group lie together, compared at distance 1, 2, ..."""
    left, right, at, lag = [], [], np.arange(len(fp)), 1
    while len(at):
        at = at[at + lag < len(fp)]
        at = at[group[at] == group[at + lag]]
        near = _pairs_apart(fp, table, at, at + lag, radius)
        left.append(at[near])
        right.append(at[near] + lag)
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def _links_block(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows a and rows b of one group, some rows at a time."""
    left, right = np.empty(0, np.int64), np.empty(0, np.int64)
    for k in range(0, len(a), 128):
        some = a[k : k + 128]
        near = np.ones((len(some), len(b)), bool)
        for p in range(table.shape[1]):
            near &= np.abs(table[some, p][:, None] - table[b, p][None, :]) <= radius
        x, y = np.nonzero(near)
        ok = np.empty(len(x), bool)
        for c in range(0, len(x), 1 << 15):
            ok[c : c + (1 << 15)] = distance(fp[some[x[c : c + (1 << 15)]]], fp[b[y[c : c + (1 << 15)]]]) <= radius
        left, right = spanning_links(len(fp), np.concatenate([left, some[x[ok]]]), np.concatenate([right, b[y[ok]]]))
    return left, right


def _words_of(column: pa.Array) -> np.ndarray:
    """Fingerprints, long or binary, as rows of 64-bit words."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)

#: Edges, both ways counted, up to which a round of similar_components deals a hub's edges to one task (16 bytes each).
FEW_EDGES = 1_000_000


def _by_bucket(solve, binary: bool = False):
    """Rows (key, lo, hi, blk, fp, node) arrive sorted by (key, lo, hi); ``solve`` gets whole buckets, many or one at a time."""
    names = ["key", "lo", "hi", "blk", "fp", "node"]

    def read(batch: pa.RecordBatch, name: str) -> np.ndarray:
        column = batch.column(batch.schema.get_field_index(name))
        if name != "fp":
            return column.to_numpy(zero_copy_only=False)
        return np.array([*column.to_pylist(), None], object)[:-1] if binary else _words_of(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [read(batch, n) for n in names]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            cut = int(np.argmax(last))
            if cut:
                yield solve([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield solve(held)

    return run


def _buckets(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where buckets start, and how many rows each has."""
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    return start, np.diff(np.r_[start, len(key)])


def _compare(radius: int):
    """Per bucket the links at ``radius`` or fewer bits: (u, v), spanning ones only."""
    pivots = reference_fingerprints(PIVOTS)

    def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, lo, hi, blk, fp, node = rows
        table = pivot_table(fp, pivots)
        start, size = _buckets(key, lo, hi)
        group = np.repeat(np.arange(len(start)), size)
        small = np.flatnonzero((size[group] <= _SMALL) & (hi == lo))
        x, y = _links_small(group[small], fp[small], table[small], radius)
        i, j = [small[x]], [small[y]]
        for s, n in zip(start, size):
            if n > 1 and (n > _SMALL or hi[s] != lo[s]):
                own = blk[s : s + n]
                x, y = _links_block(fp[s : s + n], table[s : s + n], np.flatnonzero(own == lo[s]), np.flatnonzero(own == hi[s]), radius)
                i.append(x + s)
                j.append(y + s)
        i, j = np.concatenate(i), np.concatenate(j)
        names, inverse = np.unique(node, return_inverse=True)
        u, v = spanning_links(len(names), inverse[i], inverse[j])
        return pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v])], ["u", "v"])

    return _by_bucket(solve)


def _segments(count: int, radius: int) -> list[int]:
    """Segment widths: more segments, and so longer keys, the more fingerprints there are."""
    b = radius + (2 if count <= 1 << 22 else 3 if count <= 1 << 27 else 4)
    return [64 // b + (k < 64 % b) for k in range(b)]


def _met(keyed: DataFrame) -> DataFrame:
    """keyed(key, fp, node) dealt so that rows of a key meet: large keys in blocks, each pair of blocks in an own group.

    The table of large keys is written and counted first: without any the rows are dealt by key alone, up to LARGE_KEYS it
    is broadcast, beyond that joined by key. So the rows themselves are shuffled once unless there are very many.
    """
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)
    large = materialize(large.select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("g")), "large-keys")
    count = large.count()
    if not count:
        zero = F.lit(0)
        return keyed.select("key", zero.alias("lo"), zero.alias("hi"), zero.alias("blk"), "fp", "node").repartition("key").sortWithinPartitions("key")
    dealt = keyed.join(F.broadcast(large) if count <= LARGE_KEYS else large, "key", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("g")).cast("int"))
    dealt = dealt.select("key", "blk", "fp", "node", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "fp", "node")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _met_apart(members: DataFrame) -> DataFrame:
    """members(key, label, hash) dealt so that those of a key with different labels meet, SET_ROWS at a time.

    A key's largest label is never compared with itself: its rows go to the blocks of the other labels only.
    """
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("big"), F.max("n").alias("most"), F.sum("n").alias("n"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / SET_ROWS)).cast("int")
    groups = groups.select("key", "big", blocks(F.col("n") - F.col("most")).alias("g"), blocks(F.col("most")).alias("h"), "n")
    dealt = join_counted(members, groups, "key", hot_limit(members.count()))
    big, at = F.col("label") == F.col("big"), F.xxhash64("hash", F.lit(1))
    dealt = dealt.withColumn("blk", F.when(big, F.col("g") + F.pmod(at, "h")).otherwise(F.pmod(at, "g")).cast("int"))
    dealt = dealt.select("key", "label", "hash", "blk", F.explode(F.sequence(F.lit(0), F.when(big, F.col("g")).otherwise(F.col("g") + F.col("h")) - 1)).alias("other"))
    return dealt.select("key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", F.col("label").alias("node"), "hash")


def fingerprint_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component, n) for every distinct fingerprint of ``fps(doc_id, fp)``, linked at ``radius`` or fewer bits.

    component is the smallest doc_id reachable, null if none of the rows has one; n counts the fingerprint's rows. A
    fingerprint shared by many documents is one node, and one without any doc_id links others like any. Empty: no rows.
    """
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "fingerprints")
    widths = _segments(classes.count(), radius)
    offsets = [sum(widths[:k]) for k in range(len(widths))]
    need = len(widths) - radius
    keys = []
    for n, combo in enumerate(combinations(range(len(widths)), need)):
        parts = [F.shiftrightunsigned("fp", offsets[s]).bitwiseAND(F.lit((1 << widths[s]) - 1)) for s in combo]
        key = F.lit(0).cast("long")
        for s, part in zip(combo, parts):
            key = F.shiftleft(key, widths[s]).bitwiseOR(part)
        keys.append(F.struct(F.lit(n).alias("combo"), key.alias("bits")))
    keyed = classes.select("fp", F.col("fp").alias("node"), F.inline(F.array(*keys)))
    keyed = keyed.select(F.xxhash64("combo", "bits").alias("key"), "fp", "node")
    found = connected_components(_met(keyed).transform(arrow_map, _compare(radius), "u long, v long"))
    labelled = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("label"))
    return _least_ids(materialize(labelled, "labelled"))


def _least_ids(labelled: DataFrame) -> DataFrame:
    """labelled(rep, label, ...) with component: the least rep of the rows of the label."""
    ids = labelled.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("n"))
    return join_counted(labelled.withColumnRenamed("n", "_n"), ids, "label", hot_limit(labelled.count())).withColumnRenamed("_n", "n")


def _relabelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """links(u, v) with each node replaced by its component in labels(node, component), if it has one."""
    limit = hot_limit(links.count())
    for end in ("u", "v"):
        ends = links.groupBy(end).agg(F.count("*").alias("n")).join(labels, F.col(end) == F.col("node"), "left")
        links = join_counted(links, ends.select(end, "n", F.coalesce("component", end).alias("_label")), end, limit).drop(end).withColumnRenamed("_label", end)
    return links


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Texts are lower-cased (A-Z), cut at ASCII white space, shingled by ``words``. Null or empty texts have the zero
    fingerprint and link like any other; repeated rows come out as often as they go in; a null doc_id links like any
    other and gets the component of its fingerprint (null if no document reachable has an id). Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    out = join_counted(fps, fingerprint_components(fps, radius), "fp", hot_limit(fps.count()))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def _tables(count: int) -> tuple[int, int]:
    """Key bits and number of tables: longer keys and more of them only for very many texts, so cost grows in proportion."""
    bits = max(KEY_BITS, math.ceil(math.log2(max(2, count))) - 9)
    return bits, math.ceil(TABLES * (1 / 0.848) ** (bits - KEY_BITS))


def _table_keys(bits: int, tables: int, size: int):
    """Rows (key, fp, node), one a table: a key is a sample of the fingerprint's bits."""
    rng = np.random.default_rng(SEED)
    places = [rng.choice(64 * size, bits, replace=False) for _ in range(tables)]
    worth = (1 << np.arange(bits, dtype=np.int64)).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                on = np.unpackbits(_words_of(part.column(0)).view(np.uint8), axis=1, bitorder="little").astype(np.float64)
                keys = np.concatenate([(on[:, p] @ worth).astype(np.int64) * tables + t for t, p in enumerate(places)])
                again = pa.array(np.tile(np.arange(part.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(again), part.column(1).take(again)], ["key", "fp", "node"])

    return run


def _estimate(fp: np.ndarray, i: np.ndarray, j: np.ndarray, wide: int) -> np.ndarray:
    """Distances of the pairs; over ``wide`` for those whose first words are already far apart."""
    out = np.full(len(i), wide + 1, np.int16)
    for k in range(0, len(i), 1 << 15):
        a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        near = np.flatnonzero(distance(fp[a, :FIRST_WORDS], fp[b, :FIRST_WORDS]) <= FIRST_RADIUS)
        out[k + near] = distance(fp[a[near]], fp[b[near]])
    return out


def _block_links(fp: np.ndarray, a: np.ndarray, b: np.ndarray, sure: int, wide: int) -> tuple[np.ndarray, ...]:
    """Sure and wide links between rows a and rows b of a crowded bucket, as (i, j, distance), spanning ones only.

    Pivots are rows of the bucket itself: each next one is the first row that is not surely linked to an earlier one.
    Rows near one pivot are linked by it at once; of the rest a pair is discarded by its greatest difference in distance
    to any pivot, before the pair itself is looked at.
    """
    n, i, j, table = len(fp), [], [], []
    label = np.arange(n)
    rows = np.unique(np.concatenate([a, b]))
    loose = rows
    while len(loose) and len(table) < PIVOTS:
        d = distance(fp, fp[loose[0]])
        table.append(d)
        near = rows[d[rows] <= sure]
        i.append(np.full(len(near), loose[0]))
        j.append(near)
        loose = loose[d[loose] > sure]
    label = min_labels(n, np.concatenate(i), np.concatenate(j))
    node = np.flatnonzero(label != np.arange(n))
    left, right, far = [node], [label[node]], [np.zeros(len(node), np.int16)]
    for k in range(0, len(a), 128):
        some = a[k : k + 128]
        near = label[some][:, None] != label[b][None, :]
        for d in table:
            near &= np.abs(d[some][:, None] - d[b][None, :]) <= wide
        x, y = np.nonzero(near)
        x, y = some[x], b[y]
        d = _estimate(fp, x, y, wide)
        left.append(x[d <= wide])
        right.append(y[d <= wide])
        far.append(d[d <= wide])
        x, y = x[d <= sure], y[d <= sure]
        if len(x):
            label = min_labels(n, np.r_[x, np.arange(n)], np.r_[y, label])
        left, right, far = ([np.concatenate(z)] for z in (left, right, far))
        (left, right, far) = ([z] for z in _span_grades(n, left[0], right[0], far[0], sure))
    return left[0], right[0], far[0]


def _span_grades(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, sure: int) -> tuple[np.ndarray, ...]:
    """Spanning links (i, j, distance): of the sure ones, distance 0, and of the others between their components, ``sure`` + 1."""
    ok = d <= sure
    label = min_labels(n, i[ok], j[ok])
    node = np.flatnonzero(label != np.arange(n))
    u, v = label[i[~ok]], label[j[~ok]]
    x, y = spanning_links(n, u[u != v], v[u != v])
    return np.r_[node, x], np.r_[label[node], y], np.r_[np.zeros(len(node), np.int16), np.full(len(x), sure + 1, np.int16)]


def _estimates(sure: int, wide: int):
    """Per bucket the links by estimate: (u, v, sure)."""

    def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, lo, hi, blk, fp, node = rows
        start, size = _buckets(key, lo, hi)
        group = np.repeat(np.arange(len(start)), size)
        i, j, d = [], [], []
        at, lag = np.flatnonzero((size[group] <= _SMALL) & (hi == lo)), 1
        while len(at):
            at = at[at + lag < len(fp)]
            at = at[group[at] == group[at + lag]]
            far = _estimate(fp, at, at + lag, wide)
            i.append(at[far <= wide])
            j.append(at[far <= wide] + lag)
            d.append(far[far <= wide])
            lag += 1
        for s, n in zip(start, size):
            if n > 1 and (n > _SMALL or hi[s] != lo[s]):
                own = blk[s : s + n]
                x, y, far = _block_links(fp[s : s + n], np.flatnonzero(own == lo[s]), np.flatnonzero(own == hi[s]), sure, wide)
                i.append(x + s)
                j.append(y + s)
                d.append(far)
        i, j, d = (np.concatenate([*x, np.empty(0, int)]).astype(int) for x in (i, j, d))
        names, inverse = np.unique(node, return_inverse=True)
        u, v, far = _span_grades(len(names), inverse[i], inverse[j], d, sure)
        return pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v]), pa.array(far <= sure)], ["u", "v", "sure"])

    return _by_bucket(solve)


def _verified(similarity: float):
    """Per bucket the links between nodes of different labels whose shingle sets are similar: (u, v) of labels, spanning ones only."""

    def solve(rows: list) -> pa.RecordBatch:
        key, lo, hi, blk, sets, node = rows
        names, label = np.unique(node, return_inverse=True)
        sets = [np.frombuffer(x, "<u8") for x in sets]
        size = np.array([len(x) for x in sets])
        left, right = [], []
        for s, n in zip(*_buckets(key, lo, hi)):
            e = s + n
            a, b = np.arange(s, e)[blk[s:e] == lo[s]], np.arange(s, e)[blk[s:e] == hi[s]]
            for k in a:
                some = b[(label[b] != label[k]) & (np.minimum(size[b], size[k]) >= similarity * np.maximum(size[b], size[k])) & ((lo[s] != hi[s]) | (b > k))]
                for c in range(0, len(some), 256):
                    part = some[c : c + 256]
                    if size[k] == 0:
                        same = np.zeros(len(part), int)
                    else:
                        flat = np.concatenate([sets[x] for x in part])
                        hit = sets[k][np.minimum(np.searchsorted(sets[k], flat), size[k] - 1)] == flat
                        same = np.diff(np.r_[0, np.cumsum(hit)][np.r_[0, np.cumsum(size[part])]])
                    ok = part[same >= similarity * (size[k] + size[part] - same) - 1e-9]
                    if len(ok):
                        left.append(np.full(len(ok), label[k]))
                        right.append(label[ok])
                        low = min(label[k], label[ok].min())
                        label = np.where(np.isin(label, np.r_[label[k], label[ok]]), low, label)
        none = np.empty(0, int)
        u, v = spanning_links(len(names), np.concatenate([*left, none]), np.concatenate([*right, none]))
        return pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v])], ["u", "v"])

    return _by_bucket(solve, binary=True)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, hash, component_id, label) for texts that shingle similarity of ``similarity`` or more links.

    Similarity is that of the sets of distinct shingles. Fingerprints of LONG_WORDS * 64 bits estimate the angle between
    the sets; texts meet where a sample of their bits agrees in one of many tables. A pair far enough within the limit is
    linked by its estimate (error below 1 in 10,000 at the limit). What is near it is settled by the sets themselves:
    groups that such pairs would join are brought together and every pair of them that could link is verified exactly.
    hash is that of the text, label the group, component_id its smallest doc_id (null if no row has one). Equal
    fingerprints are one node. Null and empty texts link with each other; null ids link like any.
    """
    size = LONG_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([long_fingerprint(t.as_py(), words, size).tobytes() for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], ["doc_id", "hash", "fp"])
        pa.default_memory_pool().release_unused()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([np.unique(shingle_hashes(t.as_py(), words)).astype("<u8").tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), own], ["hash", "fp"])

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    fps = materialize(own.transform(arrow_map, run, "doc_id long, hash long, fp binary").withColumn("node", F.xxhash64("fp")), "long-simhash")
    classes = materialize(fps.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("hash").alias("hash"), F.min("fp").alias("fp"), F.count("*").alias("n")), "fingerprints")
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    error = math.sqrt(64 * size * share * (1 - share))
    sure, wide = int(64 * size * share - SURE_ERRORS * error), int(64 * size * share + WIDE_ERRORS * error)
    bits, tables = _tables(classes.count())
    keyed = classes.select("fp", "node").transform(arrow_map, _table_keys(bits, tables, size), "key long, fp binary, node long")
    links = materialize(_met(keyed).transform(arrow_map, _estimates(sure, wide), "u long, v long, sure boolean"), "estimates")
    labels = materialize(connected_components(links.where("sure").select("u", "v"), FEW_EDGES), "sure-labels")
    labelled = classes.join(labels, "node", "left").select("node", "rep", "hash", "n", F.coalesce("component", "node").alias("label"))
    labelled = materialize(labelled, "labelled")
    doubtful = connected_components(_relabelled(links.where("not sure").select("u", "v"), labels), FEW_EDGES)
    doubtful = materialize(doubtful.select(F.col("node").alias("label"), F.col("component").alias("key")), "doubtful")
    if not doubtful.isEmpty():
        members = materialize(labelled.join(doubtful, "label").select("key", "label", "hash"), "doubtful-members")
        hashes = members.select("hash").distinct()
        hashes = F.broadcast(hashes) if members.count() <= LARGE_KEYS else hashes
        own_sets = own.join(hashes, "hash", "left_semi").groupBy("hash").agg(F.first("text").alias("text")).transform(arrow_map, sets, "hash long, fp binary")
        met = _met_apart(members).join(materialize(own_sets, "shingles"), "hash").drop("hash")
        met = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        more = connected_components(met.transform(arrow_map, _verified(similarity), "u long, v long"), FEW_EDGES).select(F.col("node").alias("label"), F.col("component").alias("_label"))
        labelled = materialize(labelled.join(more, "label", "left").withColumn("label", F.coalesce("_label", "label")).drop("_label"), "verified")
    found = _least_ids(labelled.select("node", "rep", "n", "label"))
    out = join_counted(fps.drop("fp"), found.select("node", "n", "component", "label"), "node", hot_limit(fps.count()))
    return out.select("doc_id", "hash", F.col("component").alias("component_id"), "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; of rows that repeat it, one.

    Near-duplicates are what similar_components links. Of several texts under the smallest id that with the smallest hash
    stays; unlike texts under one id are documents of their own. Rows without an id come last: one stays only if no row
    of its group has an id. All columns are kept, whatever their names; an empty table stays empty.
    """
    found = similar_components(docs, id_col, text_col, words, similarity)
    keepers = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("k"))
    keepers = keepers.select(F.col("k.none").alias("none"), F.coalesce("k.doc_id", F.lit(0)).cast("long").alias("id"), F.col("k.hash").alias("hash"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row").getField(id_col).cast("long")
    row = row.select(own.isNull().alias("none"), F.coalesce(own, F.lit(0)).cast("long").alias("id"), F.xxhash64(F.col("row").getField(text_col).cast("string")).alias("hash"), "row")
    # copies of a row go before the shuffle already: Spark limits each group in its map tasks
    first = F.row_number().over(Window.partitionBy("none", "id", "hash").orderBy(F.xxhash64("row")))
    one = row.withColumn("place", first).where("place = 1").join(keepers, ["none", "id", "hash"], "left_semi")
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, learnt apart on the two halves of the unit vectors, span a grid of cells. Each vector lies in one cell
and probes cells in the order of the multi-sequence traversal (ascending sum of its two halves' squared distances), as
many as a sample needs for the target recall. What lies in a probed cell is verified by cosine in double precision.
Vectors of each length have an index and cells of their own. Equal vectors are one class. A cell's residents are dealt into blocks and its probes into parts, so that a crowded cell is spread over tasks; tasks send out link counts and spanning links only, never all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.graph import HOT_ROWS, connected_components, spanning_links
from lexmill.sources.tables import arrow_map, materialize

COSINE = 0.95
#: Codebooks and traversal length are fitted on so many vectors at most, chosen by hash.
SAMPLE_ROWS = 8_000
#: Words of a codebook: so many that a cell has about CELL_ROWS vectors, within these bounds.
LEAST_WORDS, MOST_WORDS, CELL_ROWS = 4, 256, 64
TARGET_RECALL = 0.995
#: Places in a traversal are counted for so many vectors at a time.
RANK_ROWS = 32
#: So many lengths have codebooks, the most frequent ones; a rarer length is one cell, so all its pairs are compared.
FITTED_LENGTHS = 64
#: A task meets so many residents of a cell, and of its probes about so many, at a time.
BLOCK_ROWS, PROBE_ROWS = 1024, 8192
#: The vectors of all hot classes, which are broadcast, hold no more bytes than this.
HOT_BYTES = 32 << 20
ROUNDS, SEED = 12, 11


def multi_sequence(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The n pairs (i, j) of least a[i] + b[j], in ascending order (ties by position), without forming all sums."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append((int(oa[i]), int(ob[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[oa[x]] + b[ob[y]], x, y))
    return out


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (words**2).sum(1)[None, :] - 2 * x @ words.T


def _codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k-means; empty words are set to the worst-placed points."""
    rng = np.random.default_rng(SEED)
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        d = _distances(x, words)
        near = d.argmin(1)
        count = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words[count > 0] = total[count > 0] / count[count > 0, None]
        if (empty := np.flatnonzero(count == 0)).size:
            words[empty] = x[np.argsort(-d[np.arange(len(x)), near], kind="stable")[: len(empty)]]
    return words


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    probes: int

    def cells(self, unit: np.ndarray, n: int | None = None) -> np.ndarray:
        """The first n cells (number of probes by default) of each vector's traversal; column 0 is its own cell.

        Only the best words of either half can be in the first n cells, so the traversal runs over those.
        """
        n = min(n or self.probes, len(self.first) * len(self.second))
        h = unit.shape[1] // 2
        out = np.empty((len(unit), n), np.int64)
        for k in range(0, len(unit), 1024):
            da, db = _distances(unit[k : k + 1024, :h], self.first), _distances(unit[k : k + 1024, h:], self.second)
            for r in range(len(da)):
                out[k + r] = [i * len(self.second) + j for i, j in multi_sequence(da[r], db[r], n)]
        return out


    def ranks(self, unit: np.ndarray, at: np.ndarray, home: np.ndarray) -> np.ndarray:
        """The place of cell home[k] in the traversal of unit[at[k]], of equal sums the last: cells of a lesser or equal sum, less itself.

        Counted over the grid by RANK_ROWS vectors at a time, so memory doesn't grow with the length of traversals.
        """
        h, out = unit.shape[1] // 2, np.empty(len(at), np.int64)
        for k in range(0, len(at), RANK_ROWS):
            x, (i, j) = unit[at[k : k + RANK_ROWS]], np.divmod(home[k : k + RANK_ROWS], len(self.second))
            da, db = _distances(x[:, :h], self.first), _distances(x[:, h:], self.second)
            row = np.arange(len(x))
            out[k : k + RANK_ROWS] = (da[:, :, None] + db[:, None, :] <= (da[row, i] + db[row, j])[:, None, None]).sum((1, 2)) - 1
        return out


def one_cell(dim: int) -> MultiIndex:
    """A grid of one cell: every vector meets every other."""
    return MultiIndex(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)), 1)


def _sample_links(sample: np.ndarray, cosine: float) -> np.ndarray:
    near = []
    for k in range(0, len(sample), 512):
        i, j = np.nonzero(sample[k : k + 512] @ sample.T >= cosine)
        near.append(np.column_stack([i + k, j])[i + k != j])
    return np.concatenate(near)


def _at_limit(sample: np.ndarray, cosine: float) -> np.ndarray:
    """For each vector one in a random direction whose cosine with it is the limit."""
    away = np.random.default_rng(SEED).normal(size=sample.shape)
    away -= (away * sample).sum(1)[:, None] * sample
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-300)[:, None]
    return cosine * sample + np.sqrt(1 - cosine * cosine) * away


def fit(sample: np.ndarray, rows: int, cosine: float = COSINE, target: float = TARGET_RECALL) -> MultiIndex:
    """Codebooks for ``rows`` vectors in all, and the least traversal length that finds ``target`` of the sample's links.

    A sample without links is measured on made-up partners at the limit. The length may be that of the whole grid, which
    loses nothing.
    """
    words = LEAST_WORDS
    while words < MOST_WORDS and words * words * 4 * CELL_ROWS <= rows:
        words *= 2
    if not len(sample):
        return one_cell(sample.shape[1])
    h = sample.shape[1] // 2
    index = MultiIndex(_codebook(sample[:, :h], words), _codebook(sample[:, h:], words), 1)
    pairs = _sample_links(sample, cosine)
    pairs = pairs[np.random.default_rng(SEED).permutation(len(pairs))[:50_000]]
    own = index.cells(sample, 1)[:, 0]
    if len(pairs):
        vectors, at, home = sample, pairs[:, 0], own[pairs[:, 1]]
    else:
        vectors, at, home = _at_limit(sample, cosine), np.arange(len(sample)), own
    # a group's size must not drown the hard pairs: every asked vector weighs the same
    weight = 1 / np.bincount(at)[at]
    found = np.bincount(index.ranks(vectors, at, home), weight).cumsum() / weight.sum()
    return MultiIndex(index.first, index.second, int(np.flatnonzero(found >= min(target, found[-1]))[0]) + 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _place(indexes: dict[int, MultiIndex]):
    """Unit vectors with their cell and the cells they probe; a cell's upper half is the length of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dim in map(int, np.unique(sizes)):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                unit = x / np.linalg.norm(x, axis=1)[:, None]
                cells = (indexes.get(dim) or one_cell(dim)).cells(unit) + (dim << 32)
                vec = pa.array([r.tobytes() for r in unit.astype("<f8")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), vec, pa.array(cells[:, 0]), pa.array(list(cells), pa.list_(pa.int64()))], ["rep", "n", "vec", "cell", "probes"])

    return run


def _verify(cosine: float):
    """Per (cell, blk), a block's number in the upper and a part's in the lower half of blk: first the residents, then the
    probes in a stream; link counts and spanning links go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home = None, None

        def out(a, b, c) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=np.asarray(c) > 0), pa.array(c, pa.int64())], ["a", "b", "links"])

        def meet(part: dict, cell: int) -> Iterator[pa.RecordBatch]:
            res_rep, res_n, res_vec, res_probes = home
            for k in range(0, len(part["rep"]), 512):
                rep, n, own = part["rep"][k : k + 512], part["n"][k : k + 512], part["own"][k : k + 512]
                i, j = np.nonzero(part["vec"][k : k + 512] @ res_vec.T >= cosine)
                apart = rep[i] != res_rep[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    continue
                # the other side doesn't probe this probe's cell, so its link is counted here too
                one_way = ~(res_probes[j] == own[i][:, None]).any(1)
                count = np.bincount(i, res_n[j], len(rep)).astype(np.int64)
                back = np.bincount(j[one_way], n[i[one_way]], len(res_rep)).astype(np.int64)
                yield out(np.r_[rep[count > 0], res_rep[back > 0]], np.zeros((count > 0).sum() + (back > 0).sum(), np.int64), np.r_[count[count > 0], back[back > 0]])
                names, at = np.unique(np.r_[rep, res_rep], return_inverse=True)
                u, v = spanning_links(len(names), at[i], at[len(rep) + j])
                yield out(names[u], names[v], np.zeros(len(u), np.int64))

        for batch in batches:
            cell, blk, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            edges = np.r_[0, np.flatnonzero((cell[1:] != cell[:-1]) | (blk[1:] != blk[:-1]) | (kind[1:] != kind[:-1])) + 1, len(cell)]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                rows = {"rep": part.column(3).to_numpy(), "n": part.column(4).to_numpy(), "vec": _matrix(part.column(5)), "own": part.column(6).to_numpy()}
                if kind[s] == 0:
                    probes = np.array(part.column(7).to_pylist(), np.int64).reshape(e - s, -1)
                    more = key == (cell[s], blk[s])
                    fresh = (rows["rep"], rows["n"], rows["vec"], probes)
                    home = tuple(np.concatenate(x) for x in zip(home, fresh)) if more else fresh
                    key = (cell[s], blk[s])
                elif key == (cell[s], blk[s]):
                    yield from meet(rows, int(cell[s]))

    return run


def _fit_lengths(classes: DataFrame, cosine: float) -> dict[int, MultiIndex]:
    """An index for each of the FITTED_LENGTHS most frequent lengths, each on its share of the sample."""
    size = F.size("v")
    counts = {r.d: r["count"] for r in classes.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(FITTED_LENGTHS).collect()}
    # the threshold lets through some rows more than the sample has, so that tasks don't send a sample each
    place = F.pmod(F.xxhash64("rep", "v"), F.lit(1 << 40))
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, sum(counts.values())))
    some = classes.where(size.isin(list(counts)) & (place < int(share * (1 << 40)))).orderBy(place, "rep").limit(SAMPLE_ROWS).select("v").collect()
    out = {}
    for dim, rows in counts.items():
        sample = np.array([r.v for r in some if len(r.v) == dim], float).reshape(-1, dim)
        norm = np.linalg.norm(sample, axis=1)
        out[dim] = fit(sample / np.maximum(norm, 1e-300)[:, None], rows, cosine)
    return out


def vector_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; others link only with
    vectors of their own length. Repeated rows count as separate vectors that link. A null
    vec_id is counted as a partner but has no component of its own: it shows that of its equals, else null, and is kept
    only then. Other columns are ignored; an empty table stays empty.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)).alias("good")
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    every = materialize(every.select("vec_id", "v", good), "vectors")
    usable = every.where("good").drop("good")
    classes = materialize(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).where("rep is not null").select("rep", "n", "v"), "vector-classes")
    placed = materialize(classes.transform(arrow_map, _place(_fit_lengths(classes, cosine)), "rep long, n long, vec binary, cell long, probes array<long>"), "vector-cells")
    asked = placed.select(F.col("cell").alias("own"), F.explode("probes").alias("cell"), "rep", "n", "vec")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("blocks"))
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("long").alias("parts"))
    cells = materialize(blocks.join(parts, "cell"), "vector-crowds")
    # every block of residents meets every part of the probes, in one place each
    place = lambda block, part: F.shiftleft(block, 32).bitwiseOR(part).alias("blk")
    block, part = F.pmod(F.xxhash64("rep"), "blocks"), F.pmod(F.xxhash64("rep", F.lit(1)), "parts")
    each_part, each_block = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias("_k") for c in ("parts", "blocks"))
    residents = placed.join(cells, "cell").select("*", each_part).select("cell", place(block, F.col("_k")), F.lit(0).alias("kind"), "rep", "n", "vec", F.col("cell").alias("own"), "probes")
    probes = asked.join(cells, "cell").select("*", each_block)
    probes = probes.select("cell", place(F.col("_k"), part), F.lit(1).alias("kind"), "rep", "n", "vec", "own", F.lit(None).cast("array<long>").alias("probes"))
    met = residents.unionByName(probes).repartition("cell", "blk").sortWithinPartitions("cell", "blk", "kind")
    found = materialize(met.transform(arrow_map, _verify(cosine), "a long, b long, links long"), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    by_class = classes.join(counts, classes.rep == counts.node, "left").drop("node").join(components, F.col("rep") == F.col("node"), "left")
    by_class = by_class.select("v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    out = _joined_classes(usable, by_class, classes)
    out = out.unionByName(every.where("not good").select("vec_id", F.lit(None).cast("long").alias("_links"), F.lit(None).cast("long").alias("_component")))
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def _joined_classes(usable: DataFrame, by_class: DataFrame, classes: DataFrame) -> DataFrame:
    """(vec_id, _links, _component) of every usable row, null where its vector has no class.

    A class of more than ``limit`` rows is broadcast, so its rows stay where they are; the limit grows with the bytes of
    all vectors, so that all such classes' vectors together hold no more than HOT_BYTES. The others are dealt by vector.
    """
    size = classes.agg(F.sum(F.size("v") * F.col("n")) * 8).first()[0] or 0
    hot = F.col("n") > max(HOT_ROWS, size // HOT_BYTES)
    few, rest = F.broadcast(by_class.where(hot).drop("n")), by_class.where(~hot).drop("n")
    left = usable.join(F.broadcast(classes.where(hot).select("v")), "v", "left_anti")
    return usable.join(few, "v").unionByName(left.join(rest, "v", "left")).select("vec_id", "_links", "_component")

"""Exact cosine search of a stated query set against all rows, and hashed text embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.providers import DIMS, bucket
from lexmill.functions.text import char_grams
from lexmill.sources.tables import arrow_map, materialize, ship_code

#: Bytes of query vectors, and best rows of all queries, that a task holds in one scan of the rows; a larger query set is
#: worked off in so many scans. Similarities, and components of rows, that a task has at once.
QUERY_BYTES, MOST_BEST, MOST_SIMS, MOST_VALUES = 16 << 20, 1 << 19, 1 << 19, 1 << 19
#: Pairs up to which their documents' ids are broadcast.
MOST_PAIRS = 1_000_000
#: All rows against all: components of a block of rows; blocks that are made at least, unless they had fewer rows than that;
#: rows on the two sides of a tile of similarities.
BLOCK_VALUES, LEAST_BLOCKS, LEAST_ROWS, TILE_ROWS, TILE_QUERIES = 1 << 22, 8, 1024, 1024, 512


def unit(vector: Column) -> Column:
    """The vector over its length, in double; null for null, zero or non-finite vectors."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((norm > 0) & (norm < F.lit(float("inf"))), F.transform(v, lambda x: x / norm))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """(qid, doc_id, sim rounded to 6 places): every query's k best rows, and more of them, for vectors(doc_id, vec) and
    queries(qid, vec). A window over the result picks the k best; the best one is the greatest similarity of all rows.

    A stated query set against all rows, in blocks: queries are counted first, and dealt to blocks of QUERY_BYTES, or of
    MOST_BEST / k queries, by a hash of qid; a block is one matrix on every task, and one scan of the rows. A task keeps the
    k best of each query, ties by doc_id, so it sends at most k rows a query. Vectors meet those of their own length; with ``strict`` a row whose length
    no query has raises. Null, zero and non-finite vectors, and those with null components, give no rows.
    """
    size = F.size("vec")
    asked = queries.where("vec is not null").select(F.col("qid").cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("vec"))
    total, n_asked = asked.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-total * 8 // QUERY_BYTES), -(-n_asked * k // MOST_BEST))
    out = None
    for n in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n)
        part = _against(vectors, block.toArrow(), k, strict)
        out = part if out is None else out.unionByName(part)
    return out


def neighbours(rows: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, sim rounded to 6 places, same): the k best rows with another id of every row of rows(doc_id, vec, label),
    and more of them; same says whether the two labels are equal. A window over the result picks the k best.

    All rows against all, exactly: rows are dealt to blocks by a hash of doc_id, and every pair of blocks is compared by one
    task, once for both directions. A task holds two blocks of about BLOCK_VALUES components and MOST_BEST / k rows at most, and sends
    at most k rows for each of their rows. Work grows with the square of the rows; what is shuffled grows with their number
    times that of the blocks. Rows that ``nearest`` leaves out are left out here.
    """
    own = rows.where("doc_id is not null and vec is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "vec", "label")
    total, n = own.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-total // BLOCK_VALUES), -(-n * k // MOST_BEST), min(LEAST_BLOCKS, -(-n // LEAST_ROWS)))
    dealt = own.withColumns({"block": F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    high = F.greatest("block", "other")
    cell = F.shiftright(high * (high + 1), 1) + F.least("block", "other")  # pairs of blocks are numbered without a gap
    dealt = dealt.select(cell.alias("cell"), F.signum(F.col("block") - F.col("other")).cast("int").alias("side"), "doc_id", "vec", "label")

    def run(cell: pa.Table) -> pa.Table:
        ids, side = (cell.column(c).to_numpy() for c in ("doc_id", "side"))
        pairs = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at, x in _usable(pa.array(np.arange(len(ids))), cell.column("vec").combine_chunks()).values():
            by_id = np.argsort(ids[at], kind="stable")
            at, x = at[by_id], x[by_id]
            first, second = side[at] <= 0, side[at] >= 0
            pairs += _compared((at[first], x[first]), (at[second], x[second]), ids if (side == 0).any() else None, k)
        query, row, sims = (np.concatenate(x) for x in zip(*pairs))
        label = cell.column("label").combine_chunks()
        same = pc.equal(label.take(pa.array(query)), label.take(pa.array(row)))
        return pa.table([pa.array(ids[query]), pa.array(ids[row]), pa.array(sims), same], ["qid", "doc_id", "sim", "same"])

    ship_code(rows.sparkSession)
    return dealt.repartitionById(blocks * (blocks + 1) // 2, "cell").groupBy("cell").applyInArrow(run, "qid long, doc_id long, sim double, same boolean")


def pair_similarities(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs(qid, doc_id, ...) with sim, rounded to 6 places; 0 where either side has no usable vector.

    The pairs are stored; if their documents are at most MOST_PAIRS, only these documents' vectors leave the scan.
    """
    pairs = materialize(pairs, "pairs")
    named = pairs.select("doc_id").distinct()
    if pairs.count() <= MOST_PAIRS:
        vectors = vectors.join(F.broadcast(named), "doc_id", "left_semi")
    docs = vectors.select("doc_id", unit(F.col("vec")).alias("_d"))
    asked = queries.select("qid", unit(F.col("vec")).alias("_q"))
    dot = F.aggregate(F.zip_with("_d", "_q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    both = pairs.join(docs, "doc_id", "left").join(asked, "qid", "left")
    return both.withColumn("sim", F.coalesce(F.round(dot, 6), F.lit(0.0))).drop("_d", "_q")


def _usable(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the ids and unit vectors, in double, of the usable rows."""
    lists = vectors.cast(pa.list_(pa.float64()))
    values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    start, end = (lists.offsets.to_numpy(zero_copy_only=False)[x].astype(np.int64) for x in (slice(None, -1), slice(1, None)))
    length = np.where(lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False), end - start, 0)
    out, names = {}, ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == n)
        x = values[start[at][:, None] + np.arange(n)]
        with np.errstate(invalid="ignore", over="ignore"):
            norm = np.linalg.norm(x, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        out[n] = names[at[good]], x[good] / norm[good][:, None]
    return out


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most MOST_VALUES components (one row at least)."""
    size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // MOST_VALUES
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b > a:
            yield batch.slice(a, b - a)


class _Best:
    """The k best (sim, then smaller id) of each of n queries; candidates wait until there are many."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -2.0)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.limit = 0, max(200_000, 2 * n * k)

    def add(self, ids: np.ndarray, sims: np.ndarray) -> None:
        row, query = np.nonzero(sims >= self.least)
        self.parts.append((query, ids[row], sims[row, query]))
        self.waiting += len(row)
        if self.waiting > self.limit:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, ids, sims = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -sims, query))
        query = query[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        kept = order[place < self.k]
        self.parts = [(query[place < self.k], ids[kept], sims[kept])]
        self.waiting = len(kept)
        last = place == self.k - 1
        self.least[query[last]] = sims[order[last]]
        return self.parts[0]


class _Nearest(_Best):
    """The same in tiles. Rows come by ascending id, so one that only equals the k-th best so far is not among the best."""

    def tile(self, sims: np.ndarray, start: int, first: int, axis: int) -> None:
        """sims of the queries from number ``start`` on, which lie along the other axis, with the rows from ``first`` on along ``axis``."""
        n = sims.shape[1 - axis]
        least = self.least[start : start + n]
        limit = least + 5e-7  # rounded values lie 1e-6 apart
        if (new := least < -1).any() and sims.shape[axis] >= self.k:  # the tile's own k-th best is a first limit
            at = sims.shape[axis] - self.k
            own = np.maximum(np.round(np.partition(sims, at, axis=axis).take(at, axis=axis), 6), -2.0)
            limit = np.where(new, own - 5e-7, limit)
            least[new] = own[new]
        where = np.flatnonzero(sims > np.expand_dims(limit - 6e-7, axis))
        pair = np.divmod(where, sims.shape[1])
        query, row, found = pair[1 - axis], pair[axis], np.round(sims.ravel()[where], 6)
        good = found > limit[query]
        self.parts.append((query[good] + start, row[good] + first, found[good]))
        self.waiting += int(good.sum())
        if self.waiting > self.limit:
            self.settle()


def _compared(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], ids: np.ndarray | None, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, sim) of the k best of every row of first(number, unit vector) in second, and the other way round; rows are
    sorted by id. With ``ids``, by number, both are the same rows, and those of one id don't meet."""
    (a, x), (b, y) = first, second
    of_a, of_b = _Nearest(len(a), k), _Nearest(len(b), k)
    for q in range(0, len(b), TILE_QUERIES):
        for r in range(0, len(a), TILE_ROWS):
            sims = x[r : r + TILE_ROWS] @ y[q : q + TILE_QUERIES].T
            if ids is None:
                of_a.tile(sims, r, q, 1)
            else:
                sims[ids[a[r : r + TILE_ROWS]][:, None] == ids[b[q : q + TILE_QUERIES]]] = -3.0
            of_b.tile(sims, q, r, 0)
    (one, its_row, sim), (other, other_row, other_sim) = of_a.settle(), of_b.settle()
    return [(a[one], b[its_row], sim), (b[other], a[other_row], other_sim)]


def _against(vectors: DataFrame, asked: pa.Table, k: int, strict: bool) -> DataFrame:
    queries = _usable(asked.column("qid").combine_chunks(), asked.column("vec").combine_chunks()) if asked.num_rows else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: _Best(len(names), k) for n, (names, _) in queries.items()}
        for batch in (part for whole in batches for part in _parts(whole)):
            for n, (ids, x) in _usable(batch.column(0), batch.column(1)).items():
                if n not in queries:
                    if strict and queries:
                        raise ValueError(f"vectors of length {n} meet queries of length {sorted(queries)}")
                    continue
                matrix = queries[n][1]
                step = max(1, MOST_SIMS // max(1, len(matrix)))
                for s in range(0, len(ids) if len(matrix) else 0, step):
                    best[n].add(ids[s : s + step], np.round(x[s : s + step] @ matrix.T, 6))
        for n, kept in best.items():
            query, ids, sims = kept.settle()
            yield pa.RecordBatch.from_arrays([pa.array(queries[n][0][query].astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(sims)], ["qid", "doc_id", "sim"])

    return vectors.select(F.col("doc_id").cast("long"), F.col("vec").cast("array<double>")).transform(arrow_map, run, "qid long, doc_id long, sim double")


def hash_embedding(rows: DataFrame, text: Column, id_col: str, dims: int = DIMS) -> DataFrame:
    """Sparse unit vectors (id, dim, weight) of hashed character trigrams, those of the development provider.

    Null text counts as empty, whose only gram is the empty one. Only counts by dimension are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(1).dictionary_encode()
            place = np.array([bucket(g, dims) for g in gram.dictionary.to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place[gram.indices.to_numpy(zero_copy_only=False)])], [id_col, "dim"])

    id_type = rows.schema[id_col].dataType.simpleString()
    grams = rows.select(F.col(id_col), F.explode(char_grams(text)).alias("gram"))
    counts = grams.transform(arrow_map, run, f"`{id_col}` {id_type}, dim int").groupBy(id_col, "dim").agg(F.count("*").alias("n"))
    norm = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, id_col).select(id_col, "dim", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))

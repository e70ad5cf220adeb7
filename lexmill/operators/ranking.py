"""BM25 for many queries at once: every document is counted and scored where its text is read; nothing of it is shuffled.

texts(doc_id, text) holds one row a document, the text normalised. A search is two scans: one counts the documents of each
term, one scores every document for every query and keeps the k best of each query in the task. A task sends one number a
term, and at most k rows a query, however many documents and words there are, and however frequent they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import normalized_array
from lexmill.operators.vectors import MOST_BEST, _Best
from lexmill.params import DEFAULT, Params
from lexmill.sources.tables import arrow_map, materialize

#: Bytes of text whose words are counted at once; scores, and summands of scores, that a task has at once.
PIECE_BYTES, MOST_CELLS = 4 << 20, 1 << 19
#: Distinct terms, and kept terms of all queries, that one scan of the texts looks for; more of them take more scans.
MOST_TERMS, MOST_KEPT = 100_000, 1 << 18


@dataclass
class Texts:
    rows: DataFrame
    n_docs: int


def unique_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether every row has an id of its own. Only ids are read and shuffled."""
    n_rows, n_ids = docs.agg(F.count("*"), F.count_distinct(id_col)).first()
    return n_rows == n_ids


def write_texts(docs: DataFrame, text: Column, path: str, id_col: str = "doc_id") -> None:
    """Store the texts, normalised where they are read; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _pieces(batch):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), normalized_array(part.column(1))], ["doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    arrow_map(rows, run, "doc_id long, text string").write.parquet(path)


def read_texts(spark: SparkSession, path: str) -> Texts:
    rows = spark.read.parquet(path)
    return Texts(rows, rows.count())


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """(first row, end row) of stretches of (doc_id, text) with about PIECE_BYTES of text."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE_BYTES
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows].tolist()
    return zip(edges[:-1], edges[1:])


def word_pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, end row, row of each word from the first, its code, the distinct words) of (doc_id, text), a piece of the rows at a time."""
    for a, b in _pieces(batch):
        parts = pc.split_pattern(pc.fill_null(batch.column(1).slice(a, b - a).cast(pa.large_string()), ""), " ")
        flat = parts.flatten()
        row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy(zero_copy_only=False)))
        there = pc.not_equal(flat, "")
        coded = flat.filter(there).dictionary_encode()
        yield a, b, row[there.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class Matcher:
    """Finds the terms that words stand for: terms ending in * are beginnings, others whole words."""

    def __init__(self, terms: pa.Array):
        self.n = len(terms)
        prefix = pc.ends_with(terms, "*").to_numpy(zero_copy_only=False)
        keys = pc.replace_substring_regex(terms, r"\*$", "").cast(pa.large_string())
        length = np.where(prefix, pc.utf8_length(keys).to_numpy(zero_copy_only=False), 0)
        self.groups = [(n, keys.take(pa.array(at)), at) for n in np.unique(length).tolist() if len(at := np.flatnonzero(length == n))]

    def counts(self, row: np.ndarray, code: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) by row and term, for the words of word_pieces."""
        found = []
        for n, keys, numbers in self.groups:
            at = pc.index_in(pc.utf8_slice_codeunits(words, 0, n) if n else words, value_set=keys)
            hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            found.append((hit, numbers[at.take(pa.array(hit)).to_numpy(zero_copy_only=False)]))
        word, term = (np.concatenate(x).astype(np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        term = term[np.argsort(word, kind="stable")]
        each = np.bincount(word, minlength=len(words))
        first, met = np.cumsum(each) - each, each[code] > 0
        row, code = row[met], code[met]
        key, tf = np.unique(np.repeat(row, each[code]) * self.n + term[_ranges(first[code], each[code])], return_counts=True)
        return key // max(1, self.n), key % max(1, self.n), tf


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``size`` numbers, one range after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def term_frequencies(texts: Texts, wanted: DataFrame) -> tuple[DataFrame, float]:
    """(term, df) of every wanted term, zero for terms without a document, stored; and the documents' mean number of words.

    One scan for MOST_TERMS terms. Each task counts its own documents and sends a number a term.
    """
    asked = materialize(wanted.select("term").distinct(), "terms")
    blocks = max(1, -(-asked.count() // MOST_TERMS))
    out = None
    for n in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == n)
        part = _frequencies(texts, block.toArrow().column("term").combine_chunks(), n == 0)
        out = part if out is None else out.unionByName(part)
    counted = materialize(out.groupBy("term").agg(F.sum("df").alias("df")), "term-counts")
    n_tokens = counted.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    df = asked.join(counted, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))
    return materialize(df, "term-frequencies"), n_tokens / max(1, texts.n_docs)


def _frequencies(texts: Texts, terms: pa.Array, sizes: bool) -> DataFrame:
    """(term, df) of a task each; with ``sizes`` a null term has the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, df, n_tokens = Matcher(terms), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for _, _, row, code, words in word_pieces(batch):
                n_tokens += len(row)
                df += np.bincount(matcher.counts(row, code, words)[1], minlength=len(terms))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(there)).cast(pa.string()), pa.array(df[there])], ["term", "df"])
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([n_tokens], pa.int64())], ["term", "df"])

    return arrow_map(texts.rows, run, "term string, df long")


def best_documents(texts: Texts, kept: DataFrame, average: float, k: int, by: tuple[str, ...] = ("qid",), p: Params = DEFAULT) -> DataFrame:
    """(by, doc_id, score): every query's k best documents by BM25, and more of them, for kept(by, term, weight), a query being
    a value of the columns ``by``. A window over the result picks the k best. Documents with none of its terms are left out.

    Queries are dealt to blocks of about MOST_KEPT terms, or MOST_BEST / k queries, by a hash; a block is one scan of the texts.
    """
    kept = materialize(kept.select(*by, "term", "weight"), "kept-terms")
    n_kept, n_asked = kept.count(), kept.select(*by).distinct().count()
    blocks = max(1, -(-n_kept // MOST_KEPT), -(-n_asked * k // MOST_BEST))
    out = None
    for n in range(blocks):
        block = kept if blocks == 1 else kept.where(F.pmod(F.xxhash64(*by), F.lit(blocks)) == n)
        part = _scored(texts, block.toArrow(), average, k, kept.select(*by).dtypes, p)
        out = part if out is None else out.unionByName(part)
    return out


def _scored(texts: Texts, kept: pa.Table, average: float, k: int, types: list[tuple[str, str]], p: Params) -> DataFrame:
    by = [c for c, _ in types]
    numbers: dict[tuple, int] = {}
    query = np.array([numbers.setdefault(key, len(numbers)) for key in zip(*(kept.column(c).to_pylist() for c in by))], np.int64)
    terms = kept.column("term").combine_chunks().dictionary_encode()
    code, weight = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), kept.column("weight").to_numpy()
    order = np.argsort(code, kind="stable")
    query, weight, asking = query[order], weight[order], np.bincount(code, minlength=len(terms.dictionary))
    names = [pa.array(c, kept.schema.field(name).type) for name, c in zip(by, zip(*numbers))] or [pa.array([], kept.schema.field(c).type) for c in by]
    terms, first, size = terms.dictionary, np.cumsum(asking) - asking, len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, best = Matcher(terms), _Best(size, k)
        for batch in batches if size else ():
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, row, code, words in word_pieces(batch):
                length = np.bincount(row, minlength=b - a)
                row, term, tf = matcher.counts(row, code, words)
                part = tf * (p.bm25_k1 + 1) / (tf + p.bm25_k1 * (1 - p.bm25_b + p.bm25_b * length[row] / average))
                load = np.bincount(row, weights=asking[term], minlength=b - a).astype(np.int64) + size
                edges = np.r_[0, np.flatnonzero(np.diff(np.cumsum(load) // MOST_CELLS)) + 1, b - a]
                for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    own = slice(*np.searchsorted(row, (s, e)).tolist())
                    n = asking[term[own]]
                    at = _ranges(first[term[own]], n)
                    cell = np.repeat((row[own] - s) * size, n) + query[at]
                    score = np.bincount(cell, weights=weight[at] * np.repeat(part[own], n), minlength=(e - s) * size).reshape(e - s, size)
                    best.add(ids[a + s : a + e], np.where(score > 0, np.round(score, 6), -3.0))
        asked, found, score = best.settle()
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(asked)) for c in names), pa.array(found.astype(np.int64)), pa.array(score)], [*by, "doc_id", "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in types)
    return arrow_map(texts.rows, run, f"{schema}, doc_id long, score double")

"""Target-distribution importance resampling: hashed n-gram features, log gains a bucket, and a draw without replacement.

Every task keeps a word trie of its own. A node stands for a run of words; it holds how often the run was seen and the
CRC-32 state of its UTF-8 bytes, so a longer run's checksum goes on from its parent's. Tasks send bucket totals only
(``buckets`` rows each), which one aggregation merges. A second pass walks each document's runs through a trie whose
nodes carry the gains of their buckets. Gumbel noise from a hash of the id turns the highest scores into a draw.

A trie is emptied when it has MOST_NODES nodes; its totals are sent by then, so that changes no result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.columns import spare_name
from lexmill.llm.wordids import pieces_of
from lexmill.sources.tables import arrow_map, materialize

BUCKETS = 10_000
#: Nodes of one task's trie at most, besides those of one piece of text.
MOST_NODES = 1_000_000
PIECE_BYTES = 4 << 20
SEED = 2024
LEAST_WORDS = 20
#: What separates words before they are lower-cased.
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class WordTrie:
    """Runs of up to ``longest`` words. children[(parent, word)] is a node; node 0 is the root."""

    def __init__(self, longest: int, buckets: int, gains: np.ndarray | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.totals = np.zeros(buckets, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.word_ids: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.children: dict[int, int] = {}
        self.state = np.zeros(1 << 12, np.uint32)
        self.count = np.zeros(1 << 12, np.int64)
        self.gain = np.zeros(1 << 12, np.int64)
        self.nodes = 1

    def flush(self) -> np.ndarray:
        """Counts by bucket of all that was walked; the trie starts again."""
        at = (self.state[1 : self.nodes] % self.buckets).astype(np.int64)
        np.add.at(self.totals, at, self.count[1 : self.nodes])
        out, self.totals = self.totals, np.zeros(self.buckets, np.int64)
        self._clear()
        return out

    def _words(self, distinct: pa.Array) -> np.ndarray:
        known, out = self.word_ids, np.empty(len(distinct), np.int64)
        for k, w in enumerate(distinct.cast(pa.large_binary()).to_pylist()):
            i = known.get(w)
            if i is None:
                i = known[w] = len(self.words)
                self.words.append(w)
            out[k] = i
        return out

    def _nodes(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node below each parent by each word, made where it is missing."""
        keys, at = np.unique(parent << 32 | word, return_inverse=True)
        nodes, children = np.empty(len(keys), np.int64), self.children
        new = []
        for k, key in enumerate(keys.tolist()):
            node = children.get(key)
            if node is None:
                node = children[key] = self.nodes + len(new)
                up, w = key >> 32, self.words[key & 0xFFFFFFFF]
                new.append(zlib.crc32(b" " + w, int(self.state[up])) if up else zlib.crc32(w))
            nodes[k] = node
        if new:
            need = self.nodes + len(new)
            if need > len(self.state):
                more = need + (need >> 1)
                for name in ("state", "count", "gain"):
                    old = getattr(self, name)
                    grown = np.zeros(more, old.dtype)
                    grown[: len(old)] = old
                    setattr(self, name, grown)
            self.state[self.nodes : need] = new
            if self.gains is not None:
                self.gain[self.nodes : need] = self.gains[self.state[self.nodes : need] % self.buckets]
            self.nodes = need
        return nodes[at]

    def walk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: words, runs, and the sum of its runs' gains (zeros without gains). Runs are counted in the nodes."""
        if self.nodes > MOST_NODES:
            self.totals = self.flush()
        parts = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), _NOT_WORD)
        flat = parts.flatten()
        row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy(zero_copy_only=False)))
        there = pc.not_equal(flat, "")
        row = row[there.to_numpy(zero_copy_only=False)]
        coded = flat.filter(there).dictionary_encode()
        # only distinct words are lower-cased: Arrow's ascii_lower misreads a slice that was cast, and pieces are slices
        word = self._words(pc.ascii_lower(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)] if len(row) else np.empty(0, np.int64)
        n_words = np.bincount(row, minlength=len(texts))
        runs, gains = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        node, own, starts = np.zeros(len(word), np.int64), row, np.arange(len(word))
        for k in range(self.longest):
            if k:  # a run that would leave its text ends here
                stays = np.flatnonzero((starts + k < len(word)) & (row[np.minimum(starts + k, len(word) - 1)] == own))
                node, own, starts = node[stays], own[stays], starts[stays]
            if not len(starts):
                break
            node = self._nodes(node, word[starts + k])
            np.add.at(self.count, node, 1)
            runs += np.bincount(own, minlength=len(texts))
            if self.gains is not None:
                np.add.at(gains, own, self.gain[node])
        return n_words, runs, gains


def bucket_totals(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many runs of 1 to ``longest`` words of all texts fall into each bucket; buckets without any are absent.

    Null and empty texts have no runs; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(longest, buckets)
        for batch in batches:
            for part in pieces_of(batch, 0, PIECE_BYTES):
                trie.walk(part.column(0))
        totals = trie.flush()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(totals[at])], ["bucket", "n"])

    sent = texts.select(F.col(text_col).cast("string").alias("text")).transform(arrow_map, run, "bucket long, n long")
    return sent.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket, from two tables of bucket totals."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for table, into in ((raw, s), (target, t)):
        for r in table.collect():  # one row a bucket
            into[r.bucket] = r.n
    size, wanted = int(s.sum()) + buckets, int(t.sum()) + buckets
    ratio = ((t + 1).astype(float) * size) / ((s + 1).astype(float) * wanted)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, rounded down; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, and the columns ``keep`` as a struct ``row``), a row a document.

    weight is the mean gain of a document's runs, rounded down; 0 without any.
    """
    buckets = len(gain)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("boolean").alias("none"))
    inner = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(longest, buckets, gain)
        for batch in batches:
            for part in pieces_of(batch, 0, PIECE_BYTES):
                n_words, runs, total = trie.walk(part.column(0))
                weight = np.where(runs > 0, total // np.maximum(runs, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n_words.astype(np.int64)), pa.array(runs), pa.array(weight), part.column(2)], ["doc_id", "n_words", "n_features", "weight", "row"])

    out = arrow_map(inner, run, f"doc_id long, n_words long, n_features long, weight long, row {inner.schema['row'].dataType.simpleString()}")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(scored: DataFrame, percent: int = 10, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the floor(percent N / 100) highest scores of the N rows with at least
    ``least_words`` words, null for the others. Ties go to the smaller doc_id, null ids last; equal ids in any order.

    Scores are whole thousandths of a bounded logarithm, so their histogram has some ten thousand rows however large the
    input is; it gives the lowest score drawn. Only rows from that score on are sorted, by ranges, and numbered by
    place in the range and the sizes of the ranges before: no task holds more than its range, and nothing is joined.
    """
    spark = scored.sparkSession
    at = spare_name(scored, "_at")
    scored = materialize(scored.withColumn(at, F.monotonically_increasing_id()), "scores")
    fits = F.col("n_words") >= least_words
    counts = sorted(((r.score, r.n) for r in scored.where(fits).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in counts) * percent // 100
    lowest, seen = None, 0
    for score, n in counts:
        if seen >= wanted:
            break
        lowest, seen = score, seen + n
    none = F.lit(None).cast("long")
    if lowest is None:
        return scored.withColumn("rank", none).drop(at)
    chosen = fits & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc(at)]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.where(chosen).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # within a partition these ids count up in the order of its rows: the partition above 33 bits, the place below
    dealt = materialize(dealt.withColumn("_n", F.monotonically_increasing_id()), "drawn")
    part, place = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r.n for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a range
    before, offsets = 0, []
    for k in range(max(sizes) + 1):
        offsets.append(before)
        before += sizes.get(k, 0)
    table = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<long>")
    rank = F.get(table, part.cast("int")) + place + 1
    ranked = dealt.withColumn("rank", F.when(rank <= wanted, rank)).drop("_n", at)
    return scored.where(~chosen | F.col("score").isNull()).withColumn("rank", none).drop(at).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = LEAST_WORDS, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, and the columns ``keep`` as a struct ``row``.

    target: table with column ``text``. Null and empty texts have no features, weight 0, and are never drawn as they have
    no words. Repeated rows are scored alike and drawn each by itself. Other columns, whatever their names, don't matter
    unless kept. Without a target all gains follow from the raw counts alone; an empty table gives no rows.
    """
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    gain = gains(bucket_totals(texts, "text", longest, buckets), bucket_totals(target.select("text"), "text", longest, buckets), buckets)
    out = draw(scores(docs, gain, id_col, text_col, longest, seed, keep), percent, least_words)
    return out.select("doc_id", "n_features", "weight", "score", "rank", *(["row"] if keep else []))

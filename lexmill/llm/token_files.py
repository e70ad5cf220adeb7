"""Token-id files: every document its own zstandard frame under one shared dictionary.

A data set is a folder with ``dictionary`` (sha256, bytes) and ``blocks``, a Parquet table in ascending document order.
A block row holds some documents: shard and block number, ids before it in its shard, first and last doc_id, the
dictionary's hash, the id width in bytes, per document its doc_id, id count and byte offset, and the joined frames.
Short-document access reads one block (Parquet statistics on first_doc and last_doc prune the rest), looks the offset
up and decompresses that one frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.wordids import default_vocabulary, encoder_for, pieces_of
from lexmill.sources.tables import arrow_map

DICTIONARY_BYTES = 64 << 10
#: The dictionary is fitted on so many documents, chosen by hash, none longer than so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 512, 20_000
BLOCK_BYTES = 1 << 20
LEVEL = 1
BLOCKS = (
    "shard int, block int, before long, first_doc long, last_doc long, dict_hash string, width int, "
    "doc_ids array<long>, counts array<long>, offsets array<long>, frames binary"
)


def train_dictionary(docs: DataFrame, encoder, width: int) -> bytes:
    """A dictionary for the serialized id arrays of a bounded sample; empty if the sample is too small to train on.

    The sample is chosen by hash, below a threshold taken from the counted rows, so that tasks send little more than it.
    """
    short = docs.where(F.length("text") <= SAMPLE_CHARS)
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, short.count()))
    place = F.xxhash64("doc_id", "text")
    low = short.where(place <= F.lit(min((1 << 63) - 1, int((2 * share - 1) * (1 << 63)))).cast("long"))
    sample = low.orderBy(place).limit(SAMPLE_DOCS).collect()
    rows = [encoder.encode(pa.array([r.text])).ids.astype(f"<u{width}").tobytes() for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec_args(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _shard_of(docs: DataFrame, parts: int) -> Column:
    """The shard of doc_id: ``parts`` ranges of about equal numbers of rows. An id that fills several ranges is dealt over them.

    The bounds come from one aggregation over doc_id alone, so that the texts are read, encoded and sent on just once.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    if not cuts:
        return F.lit(0)
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")  # folded to one literal
    below = F.coalesce(F.size(F.filter(bounds, lambda x: x < F.col("doc_id"))), F.lit(0))
    equal = F.coalesce(F.size(F.filter(bounds, lambda x: x == F.col("doc_id"))), F.lit(0))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(below + F.pmod(F.xxhash64("place"), equal + 1)).cast("int")


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1) -> None:
    """Encode every document and write the data set in ascending doc_id order (rows of equal ids in any order).

    Documents are encoded and compressed where they are read; only frames are shuffled. Null or empty texts are the end id
    alone; a null doc_id sorts first; repeated rows stay; other columns are ignored. No rows: an empty table of blocks.
    """
    spark = docs.sparkSession
    vocab = vocabulary or default_vocabulary()
    encoder = encoder_for(vocab, end_id)
    width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(docs, encoder, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    types = [pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_for(vocab, end_id)
        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **_codec_args(dictionary)).compress
        for batch in batches:
            for part in pieces_of(batch, 2):
                got = coder.encode(part.column(2))
                ids, at = memoryview(got.ids.astype(f"<u{width}").tobytes()), (got.start * width).tolist()
                frames = pa.array([compress(ids[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(got.start)), frames], ["shard", "doc_id", "n", "frame"])
        pa.default_memory_pool().release_unused()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, doc_ids, counts, frames, held = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, doc_ids, counts, frames, held
            offsets = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            there = [x for x in doc_ids if x is not None]
            row = [shard, block, before, min(there, default=None), max(there, default=None), digest, width, doc_ids, counts, offsets, b"".join(frames)]
            block, before, doc_ids, counts, frames, held = block + 1, before + sum(counts), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        for batch in batches:
            for doc_id, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                frames.append(frame)
                doc_ids.append(doc_id)
                counts.append(n)
                held += len(frame)
                if held >= BLOCK_BYTES:
                    yield flush()
        if doc_ids:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.withColumn("place", F.monotonically_increasing_id()).select(_shard_of(docs, parts).alias("shard"), "doc_id", "text")
    coded = placed.transform(arrow_map, encode, "shard int, doc_id long, n long, frame binary")
    ordered = coded.repartitionById(parts, "shard").sortWithinPartitions("doc_id").select("doc_id", "n", "frame")
    ordered.transform(arrow_map, assemble, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def load_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.bytes).hexdigest() != row.sha256:
        raise ValueError("the dictionary does not match its hash")
    return bytes(row.bytes)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a data set: doc_id, start (ids of all documents before it), n_tokens, ids array<int>."""
    return _read(spark, path, "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, from the files."""
    return _read(spark, path, "ids_crc32")


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    dictionary = load_dictionary(spark, path)
    digest = hashlib.sha256(dictionary).hexdigest()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.select("shard", (F.col("before") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # one row a shard, so this window is as small as the number of shards
    shards = sizes.groupBy("shard").agg(F.max("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    kind, arrow = ("array<int>", pa.list_(pa.int32())) if what == "ids" else ("long", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor(**_codec_args(dictionary)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                out, at = [], row["before"]
                for k, n in enumerate(row["counts"]):
                    frame = row["frames"][row["offsets"][k] : row["offsets"][k + 1]]
                    ids = np.frombuffer(decompress(frame), f"<u{row['width']}")
                    if len(ids) != n:
                        raise ValueError("a frame's length differs from the index")
                    out.append(ids.astype(np.int32) if what == "ids" else zlib.crc32(ids.astype("<u4").tobytes()))
                first = np.cumsum(row["counts"]) - row["counts"] + at
                cols = [pa.array([row["shard"]] * len(out), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(first), pa.array(row["counts"], pa.int64()), pa.array(out, arrow)]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_id", "local", "n_tokens", what])

    docs = blocks.transform(arrow_map, run, f"shard int, doc_id long, local long, n_tokens long, {what} {kind}")
    return docs.join(shards, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", what)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document: one pruned block, one frame; None if it is not there. Of repeated ids the first."""
    dictionary = load_dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int")
    found = blocks.where(at > 0).select("shard", "block", "width", at.alias("at"), F.element_at("offsets", at).alias("a"), F.element_at("offsets", at + 1).alias("b"), "frames")
    row = found.select("shard", "block", "width", F.expr("substring(frames, cast(a + 1 as int), cast(b - a as int))").alias("frame")).orderBy("shard", "block").first()
    if row is None:
        return None
    return np.frombuffer(zstandard.ZstdDecompressor(**_codec_args(dictionary)).decompress(bytes(row.frame)), f"<u{row.width}").tolist()

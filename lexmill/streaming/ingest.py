"""A corpus that grows: new files are taken once, by the batch functions, and a page that comes again replaces its earlier version.

Every micro-batch is written to a partition of its own, so a replayed batch replaces itself, and nothing that was written
is read or moved later. Rows carry their version: batch, time of arrival, content hash, place. ``current`` gives the rows
of each key's last version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions.html import page_blocks
from lexmill.sources.store import replace_sources

PAGES = "page_id long, url string, html string"
#: What orders the versions of a key: later batches, later files, then the content, so that runs agree; place tells equal rows apart.
VERSION = ("batch", "arrived", "sha256", "place")
#: Keys that came again and may be broadcast; more of them meet the rows by a shuffle.
MOST_AGAIN = 1_000_000


def new_files(spark: SparkSession, path: str, schema: str, content: str, files_a_batch: int = 1000, pattern: str = "*.parquet") -> DataFrame:
    """Rows of files not taken before, as a stream, with ``arrived`` (the file's time) and the hash of column ``content``.

    path: a folder, or a glob. files_a_batch bounds a micro-batch, however long the backlog.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path).select("*", F.col("_metadata.file_modification_time").alias("arrived"), F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256).alias("sha256"))


def start(rows: DataFrame, made: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, partitions: tuple[str, ...] = (), told: Callable[[int, DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write made(batch) of every micro-batch until all files are taken.

    made gets the batch's rows with ``place`` and must leave at least one row a key, with the columns of VERSION but batch:
    a version without rows would not replace the earlier one. told(batch id, rows) may observe what is written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out_rows = made(batch.withColumn("place", F.monotonically_increasing_id())).withColumn("batch", F.lit(batch_id).cast("long"))
        replace_sources(told(batch_id, out_rows) if told else out_rows, out, "batch", *partitions)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(rows: DataFrame, key: str) -> DataFrame:
    """The rows of each key's last version. Null keys stand for themselves: they replace nothing.

    Only keys that came more than once are looked up; their number decides whether they are broadcast.
    """
    version = F.struct(*VERSION)
    ends = rows.groupBy(key).agg(F.min(version).alias("_first"), F.max(version).alias("_last"))
    again = ends.where(F.col(key).isNotNull() & (F.col("_first") != F.col("_last"))).select(key, "_last")
    if again.limit(MOST_AGAIN + 1).count() <= MOST_AGAIN:
        again = F.broadcast(again)
    return rows.join(again, key, "left").where(F.col("_last").isNull() | (version == F.col("_last"))).drop("_last")


def _page_rows(pages: DataFrame) -> DataFrame:
    key = F.struct("page_id", "arrived", "sha256", "place")
    return page_blocks(pages.select(key.alias("key"), "html"), "key", keep_empty=True).select("key.*", "pos", "tag", "class", "centered", "text", "text_raw", "bold_chars", "chars", "is_heading")


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "pages*.parquet", files_a_batch: int = 1000) -> StreamingQuery:
    """Start the ingest of new page files: blocks of every page version, one partition a micro-batch."""
    return start(new_files(spark, folder, PAGES, "html", files_a_batch, pattern), _page_rows, out, checkpoint)


def current_blocks(spark: SparkSession, out: str) -> DataFrame:
    """The blocks of each page's last version; a page that came last without blocks has none."""
    return current(spark.read.parquet(out), "page_id").where("pos is not null")

"""Corpus tables on disk: idempotent replacement by source, upserts, deletes, metadata, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.functions.html import admission
from lexmill.sources.tables import materialize


def replace_sources(rows: DataFrame, path: str, *partitions: str) -> None:
    """Write rows partitioned by source (or the columns given); a partition written again replaces its former rows, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(partitions or ("source",))).parquet(path)


def latest(rows: DataFrame, key: list[str], version: str, tie: str) -> DataFrame:
    """One row a key, of the greatest version (then tie); null counts as least. Taken in the map tasks first, so a key may have any number of rows."""
    last = F.max_by(F.struct(*rows.columns), F.struct(version, tie)).alias("_last")
    return rows.groupBy(*key).agg(last).select("_last.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete_sources(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sources in gone; a child goes with its parent."""
    return parent.join(gone, key, "left_anti"), child.join(gone, key, "left_anti")


def chunk_ids(chunks: DataFrame, *order: str) -> DataFrame:
    """chunks with a deterministic id: position in the order given, per source, with the source's hash above it.

    Rows are sorted by ranges of source and order, so a source of any size lies in many ranges; a row's position is its
    place in the range and the sizes of its source in the ranges before. Only rows equal in all of these stay together.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartitionByRange(n, "source", *order).sortWithinPartitions("source", *order)
    # these ids count up in the order of a range's rows: the range above 33 bits, the place below
    dealt = materialize(dealt.withColumn("_n", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_n", 33)
    own = dealt.groupBy(F.col("source").alias("_source"), part.alias("_part")).agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy("_source").orderBy("_part")) - F.col("_rows")  # a row a range
    own = own.withColumn("_before", before)
    met = dealt.join(own, F.col("source").eqNullSafe(F.col("_source")) & (part == F.col("_part")))
    at = F.col("_before") + F.col("_n") - F.col("_first") + 1
    chunk_id = F.shiftleft(F.xxhash64("source").bitwiseAND(F.lit((1 << 31) - 1)), 32).bitwiseOR(at.cast("long"))
    return met.withColumn("chunk_id", chunk_id).select(*chunks.columns, "chunk_id")


def write_metadata(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Metadata as (key, JSON value) rows; keys written before stay unless given again."""
    new = spark.createDataFrame(list(values.items()), "key string, value string")
    new.withColumn("part", F.col("key")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.read.parquet(path).select("key", "value").collect()}


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """A report as two JSON data sets under one folder."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/questions")


QUESTIONS = "id string, question string, kind string, expected array<string>, topic string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question file: JSON, an array or one object a line; kind is answerable or out_of_scope."""
    return spark.read.schema(QUESTIONS).option("multiLine", not path.endswith("l")).json(path)


def admitted(files: DataFrame, cache: str, least: int, marker: str, force: bool = False) -> DataFrame:
    """binaryFile rows (path, content) through a cache folder: (name, content, sha256, reason).

    A payload that the cache holds is taken from there unless ``force``; a new one is judged, and only one that is fit goes
    into the cache. A refused payload leaves what the cache holds and comes with the reason; an unchanged one isn't written.
    """
    spark = files.sparkSession
    new = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content").withColumns({"sha256": F.sha2("content", 256), "reason": admission(F.decode("content", "ISO-8859-1"), least, marker)})
    try:
        held = spark.read.parquet(cache).select("name", F.col("content").alias("old"), F.col("sha256").alias("old_sha256"))
    except AnalysisException:  # nothing cached yet
        held = spark.createDataFrame([], "name string, old binary, old_sha256 string")
    met = new.join(held, "name", "full")
    take = F.col("content").isNotNull() & F.col("reason").isNull() & (F.col("old").isNull() | (F.lit(force) & (F.col("sha256") != F.col("old_sha256"))))
    fresh = materialize(met.where(take).select("name", "content", "sha256"), "admitted")
    out = met.select("name", F.when(take, F.col("content")).otherwise(F.col("old")).alias("content"), F.when(take, F.col("sha256")).otherwise(F.col("old_sha256")).alias("sha256"), F.when(F.col("old").isNull() | F.lit(force), F.col("reason")).alias("reason"))
    out = materialize(out, "payloads")  # read before the cache changes
    fresh.withColumn("part", F.sha2("name", 256)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(cache)
    return out


def decode_pages(files: DataFrame, charset: str = "windows-1254") -> DataFrame:
    """binaryFile rows (path, content) as (path, html, sha256).

    The charset's code page is a table of 256 entries, so decoding is a translate() of Latin-1 text.
    """
    upper = bytes(range(0x80, 0x100))
    table = upper.decode(charset, errors="replace")
    latin = F.decode("content", "ISO-8859-1")
    return files.select("path", F.translate(latin, upper.decode("latin-1"), table).alias("html"), F.sha2("content", 256).alias("sha256"))


def source_url(base: str = "https://example.org/file", pattern: str = "/%s.%s.%s.htm") -> Column:
    """URL of a source from its kind, edition and number columns."""
    return F.format_string(base + pattern, F.col("kind"), F.col("edition"), F.col("number"))

"""Column helpers shared by the native operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, and what is not it.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The runs without ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``. translate() would make a string of every character."""
    return F.regexp_count(text, F.lit("[" + re.sub(r"([\\\[\]^&-])", r"\\\1", chars) + "]"))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))


def marked(docs: DataFrame, ids: DataFrame, key: str, flag: str, most: int = 2_000_000) -> DataFrame:
    """docs with boolean ``flag``: whether ``key`` is among ``ids``. Broadcast only if counted to be at most ``most`` rows."""
    ids = ids.select(F.col(key).cast("long").alias("_id")).where("_id is not null").distinct().withColumn("_there", F.lit(True))
    if ids.count() <= most:
        ids = F.broadcast(ids)
    out = docs.join(ids, docs[key].cast("long") == F.col("_id"), "left")
    return out.withColumn(flag, F.coalesce("_there", F.lit(False))).drop("_id", "_there")


def kept_rows(df: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """The rows where ``condition`` on computed columns holds, each of those computed once.

    A filter would be pushed below the projections, with a copy of every expression for every use of it; a column that
    isn't deterministic keeps it above them.
    """
    marked_rows = df.withColumn("_settled", F.monotonically_increasing_id())
    return marked_rows.where(condition & (F.col("_settled") >= 0)).select(*columns)


def spare_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores in front until no column is named so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name

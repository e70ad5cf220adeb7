"""The first k rows of every group, kept as a bounded heap in each task, so that no group is ever sorted whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.sources.tables import arrow_map

#: Rows that a task keeps before it sends them on and starts again: a bound on its memory, not on the result.
MOST_KEPT = 200_000


def first_rows(table: pa.Table, by: list[str], order: list[tuple[str, bool]], k: int) -> pa.Table:
    """At most k rows of every group of ``table``; order: (column, ascending), nulls last."""
    keys = [(c, "ascending") for c in by] + [(c, "ascending" if up else "descending") for c, up in order]
    table = table.take(pc.sort_indices(table, sort_keys=keys))
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in by:
        code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    first = np.flatnonzero(new)
    place = np.arange(table.num_rows) - np.repeat(first, np.diff(np.r_[first, table.num_rows]))
    return table.filter(pa.array(place < k))


def top_rows(rows: DataFrame, by: list[str], order: list[tuple[str, bool]], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group, with their 1-based place in the column ``rank``.

    by: plain columns, null being a group like any other. order: (column, ascending) of numbers or strings without NaN,
    nulls last; rows that are equal in all of them come in any order. Each task sends at most k rows a group (a group
    more often than once if the groups exceed MOST_KEPT rows); only those are shuffled and ordered by a window.
    """
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = first_rows(table if kept is None else pa.concat_tables([kept, table]), by, order, k)
            if kept.num_rows > MOST_KEPT:
                yield from kept.to_batches()
                kept = None
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    few = arrow_map(rows, run, schema)
    sort = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in order]
    place = F.row_number().over(W.partitionBy(*by).orderBy(*sort))
    return few.withColumn(rank, place).where(F.col(rank) <= k)

"""Connected components from edge tables, spanning links inside one task, and joins that spread frequent keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import drop_materialized, materialize

#: A key with more rows than this, and than a MOST_HOT-th of all rows, is hot; so there are at most MOST_HOT such keys.
HOT_ROWS, MOST_HOT = 256, 50_000


def min_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (i, j): the smallest node of each node's component."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def spanning_links(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 links that connect just what the given links connect."""
    label = min_labels(n, i, j)
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def hot_limit(rows: int) -> int:
    return max(HOT_ROWS, rows // MOST_HOT)


def join_counted(rows: DataFrame, table: DataFrame, key: str, limit: int) -> DataFrame:
    """Inner join of ``rows`` with ``table(key, n, ...)``, which has one row a key and in n its number of rows.

    Keys of more than ``limit`` rows, at most as many as rows / limit, are broadcast, so their rows stay where they are;
    only the others are dealt by key. n is left out.
    """
    few = F.broadcast(table.where(F.col("n") > limit).drop("n"))
    rest = table.where(F.col("n") <= limit).drop("n")
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))


def join_plain(rows: DataFrame, table: DataFrame, key: str, limit: int) -> DataFrame:
    """The same join with all rows dealt by key."""
    return rows.join(table.drop("n"), key)


def connected_components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``: component is the smallest node reachable.

    Alternating large-star and small-star rounds; each round's edges are written to the shared folder, so lineage
    stays short and lost executors cost one round. Minima are aggregated (map-side combined) and joined back; the minima
    of hubs are broadcast, their number being bounded, so that no task gets all edges of a hub. Self-links, nulls and
    repeated links are harmless; no edges gives no rows.

    A round of at most ``few`` edges, both ways counted, is joined plainly: a hub has no more than so many rows then. That
    spares the driver four broadcasts a round, and changes no result.
    """
    u, v = F.col("u"), F.col("v")
    cur = materialize(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    mark = _mark(cur)
    while mark[0]:
        limit = hot_limit(2 * mark[0])
        joined = join_plain if 2 * mark[0] <= few else join_counted
        both = cur.unionByName(cur.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = joined(both, low, "u", limit).where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))
        new = materialize(joined(large, low, "u", limit).select(F.inline(pairs)).where(u != v).distinct(), "edges")
        now = _mark(new)
        drop_materialized(cur)
        cur = new
        if mark == now:
            break
        mark = now
    roots = cur.select(v.alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(u.alias("node"), v.alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the edges: equal marks of two rounds mean that nothing moved."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

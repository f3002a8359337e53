"""Connected components in DataFrame operations.

Each round of the alternating star algorithm (Kiveris et al., 2014) links every node to the
least node around it: the large star for larger neighbours, the small star for smaller ones.
A round halves the distance to the root roughly, so the number of rounds grows with the
logarithm of a component's diameter.  Minima are partial aggregates, and joins with them are
joins that adaptive execution may split, so a node with very many edges is no single task.
Rounds are written to the shared folder; the driver sees only two sums for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b; returns such edges, distinct."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame | None:
    """(node, component) of every node with an edge, component the least node of its class;
    None if there are no edges.  ``edges`` (a, b) may repeat and hold loops; ``rows`` says about
    how many there are, where that is known."""
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows, 20)
    now = _digest(edges)
    if not now[0]:
        return None
    while True:
        last, edges = edges, durable(_star(_star(edges, True), False), "edges", now[0], 20)
        before, now = now, _digest(edges)
        discard(last)
        if now == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    found = durable(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", "node")), "components", 2 * now[0], 20)
    discard(edges)
    return found

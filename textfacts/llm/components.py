"""Connected components by alternating large-star and small-star steps.

Each step is a grouping with map-side combining and a join back on the vertex: by
broadcast where few vertices have a lesser neighbour, which leaves the edges of a hub
where they are, and by a shuffle beyond that, whose large partitions the adaptive
planner splits.  The edges are written to the shared folder between steps, never
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Least neighbours of more vertices than this (about 100 bytes each) are joined by a shuffle, not by a broadcast.
BROADCAST_VERTICES = 200_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _least(edges: DataFrame) -> DataFrame:
    """at, m: the least neighbour of each vertex that has a lesser one."""
    least = materialize(edges.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m")))
    return F.broadcast(least) if least.count() <= BROADCAST_VERTICES else least


def _large(edges: DataFrame) -> DataFrame:
    """Large-star: the greater neighbours of a vertex move to its least neighbour.

    Edges lead from the greater to the lesser vertex, so they are the edges into it.
    """
    moved = edges.join(_least(edges), F.col("b") == F.col("at"), "left")
    return moved.select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Small-star: the lesser neighbours of a vertex, and it, move to the least of them."""
    moved = edges.join(_least(edges), F.col("a") == F.col("at"))
    ends = F.explode(F.array(F.col("a"), F.col("b")))
    return moved.select(ends.alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """vertex, root (the least vertex of its component) for the vertices of ``edges`` (a, b)."""
    down = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(down.distinct())
    vertices = materialize(edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct())
    before = _state(edges)
    while before[0]:
        edges = materialize(_small(materialize(_large(edges))))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("root"))
    return vertices.join(roots, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))

"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """u and m, the smaller one of u and its smallest neighbour: one row per node, written, so that a hub's edges meet it in a join of two shuffles, which skew handling splits."""
    return materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")


def _large(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them; edges have u > v."""
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node, root): the smallest node that each node of an edge reaches.

    Rounds grow with the logarithm of a component's length. Minima are summed up map-side; a hub's edges are joined to its one row of a written table. Each round is written to the shared folder in place of
    the one before, and only an edge count and a hash of the edges go to the driver. No edges give no rows.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        larger = materialize(_large(edges), "larger")
        after = materialize(_small(larger).distinct(), "edges")
        discard(larger)
        discard(edges)
        edges = after
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link a node's neighbours to the least of them and itself: the larger ones (large star, every
    edge seen from both ends) or the smaller ones (small star, seen from its larger end)."""
    if large:
        seen = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root")
    joined = seen.join(least, F.col("a") == F.col("node"))
    if large:
        linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        linked = joined.select("b", "a", "root").select(F.explode(F.array("b", "a")).alias("a"), F.col("root").alias("b"))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root`` (the least id that the node reaches) for every node that has an edge. ``edges``
    is a written table with ``a`` and ``b``. Every round is written, so a lost executor costs one round at
    most."""
    size = edges.count()
    if not size:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0", size)
    sign = None
    for step in count(1):  # a logarithmic number of rounds
        new = scratch.table(_star(_star(now, large=True), large=False), f"{name}-{step}", 2 * size)
        scratch.drop(f"{name}-{step - 1}")
        row = new.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.countDistinct("a")).first()
        if row[0] == row[2] and tuple(row) == sign:  # every node has one edge, and nothing moves
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now, sign, size = new, tuple(row), row[0]

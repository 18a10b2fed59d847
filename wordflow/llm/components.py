"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def _with_least(around: DataFrame, least: DataFrame) -> DataFrame:
    """``around`` with the least neighbour of each u.

    The second key follows from the first; it gives the join a shuffle of its own, apart from
    that of the aggregate, so that adaptive execution can split the rows of a hub."""
    again = F.xxhash64("u").alias("again")
    return around.select("u", "v", again).join(least.select("u", "m", again), ["u", "again"])


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Every node's neighbours link to the least of them; edges have a > b."""
    if both:  # large star: larger neighbours go to the least neighbour or the node itself
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = _with_least(around.where("v > u"), least).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # small star: the node and its smaller neighbours go to the least of them
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        out = _with_least(around, least).select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b longs).

    Rows with a null end or equal ends count for nothing. Each round is cut off by a
    reliable checkpoint; the number of rounds grows with the logarithm of the diameter.
    The driver sees one count and one sum a round.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = storage.checkpoint(now)
    seen = None
    while True:
        now = storage.checkpoint(_star(_star(now, True), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        seen = mark

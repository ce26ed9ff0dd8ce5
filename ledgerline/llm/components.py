"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours join its smallest one; small star: the smaller ones do."""
    way = edges.select("a", "b")
    if large:
        way = way.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = way.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = way.join(low, "a")
    if large:
        return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return (met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % 1_000_000_007).cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node reachable.

    Loops and repeated edges do no harm; no edges give no rows. Each round is checkpointed."""
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        now = cut_lineage(_stars(_stars(now, True), False))
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

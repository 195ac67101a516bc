"""Connected components of an edge table by alternating star contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settled


def _pulled(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the smallest neighbour of u. The minima are settled, so that both sides are plain shuffles (or the minima
    are few and broadcast): Spark splits the edges of a hub."""
    return edges.join(settled(least, "least"), "u")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest of them; the edges become
    stars around the minima in a number of rounds that grows with the logarithm of the longest path. Minima are summed
    before the shuffle and joined back, so a hub with very many edges is not gathered in one place. Rounds that run out
    before the stars are complete are an error."""
    with Scratch(edges.sparkSession) as tables:
        e = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        for _ in range(most_rounds):
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = _pulled(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = _pulled(large, least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            new = settled(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
            sums = [t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() for t in (e, new)]
            e = new
            if sums[0] == sums[1]:
                break
        else:
            raise RuntimeError(f"components are not complete after {most_rounds} rounds")
        tables.keep(e)
    top = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top)

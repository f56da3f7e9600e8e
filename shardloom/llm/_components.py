"""Connected components by alternating star contractions, one shuffle-bounded pass at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, materialise


def _digest(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum((F.col("u") != F.col("v")).cast("long")).alias("d")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Columns u, v (long, undirected links) to (node, component): the smallest id each node reaches.

    Every pass replaces links by links to smaller ids.  The smallest neighbour of a node is an
    aggregate that combines before the shuffle, so a node with very many links never gathers them in
    one place.  Nodes without links aren't returned; no link gives an empty result.
    """
    paths: list[str] = []
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "cc", paths)
    seen = _digest(now)
    for _ in range(limit):
        if seen[0] == 0:
            break
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: the smaller neighbours of a node, and it, link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u != v").distinct(), "cc", paths)
        last, seen = seen, _digest(now)
        forget(edges.sparkSession, *paths[:-1])
        del paths[:-1]
        if last == seen:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

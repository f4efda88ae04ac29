"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import written


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both)
    tied = both.where("v > u").join(low, F.col("u") == F.col("_u"))
    return tied.select(F.col("v").alias("u"), F.least("_low", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    tied = down.join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_low").alias("v"))
    own = low.select(F.col("_u").alias("u"), F.col("_low").alias("v"))
    return tied.unionByName(own).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) but the roots; the
    root is the smallest node of the component.

    ``edges`` should be a written table. Each round is written to the shared
    folder, which cuts the lineage; the edges become a forest of stars after a number of rounds that grows with the
    logarithm of the number of nodes.
    """
    edges = edges.where("u <> v")
    state, n = None, edges.count()
    for _ in range(max_rounds):
        edges = written(_small_star(_large_star(edges)), "star-round", rows=n)
        new = _state(edges)
        n = new[0]
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
    raise RuntimeError(f"no forest of stars after {max_rounds} rounds")

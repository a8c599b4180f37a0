"""Connected components of very large graphs, by joins and aggregates only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b): the smallest node that it can reach.

    Distributed union-find: each round hangs every node below the smallest
    neighbour it has seen, first for larger neighbours, then for smaller ones,
    until all edges point at roots. The rounds grow with the logarithm of the
    longest path. Minima are combined before the shuffle, and the joins that
    follow are plain, so a node with very many neighbours is split by adaptive
    execution. Each round is a checkpoint. Loops and repeated edges do no harm;
    a node without any other isn't returned.
    """
    up, down = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = edges.filter("a <> b").select(up, down).distinct().checkpoint()
    seen = None
    while True:
        now = links.agg(F.count("u"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == seen:
            break
        seen = now
        links = _below_smallest(_below_larger(links)).checkpoint()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _below_larger(links: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node below the smallest of its neighbours and itself."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _below_smallest(links: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours below the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

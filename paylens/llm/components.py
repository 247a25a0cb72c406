"""Connected components of a table of edges, by alternating stars.

Each round replaces edges by others of the same components: every node's larger
neighbours are attached to its least neighbour (large star), then its smaller
ones (small star). When nothing changes, every node hangs on the least node of
its component. Neighbourhoods are never gathered: a minimum per node is
pre-aggregated, then joined back to the edges, where adaptive execution splits
a node with very many edges. Rounds grow with the logarithm of the longest
chain, and each is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import prepare


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (node, near) with node > near, after one star operation."""
    both = edges.unionByName(edges.select(F.col("near").alias("node"), F.col("node").alias("near"))) if large else edges
    least = both.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("node", "least"))
    joined = both.join(least, "node")
    if large:
        out = joined.where("near > node").select(F.col("near").alias("node"), F.col("least").alias("near"))
    else:
        out = joined.select("near", "least").unionByName(joined.select(F.col("node").alias("near"), "least"))
        out = out.where("near <> least").select(F.col("near").alias("node"), F.col("least").alias("near"))
    return out.distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an edge; root is the least node of its component.

    Edges may repeat, point either way or be loops; a node with loops only is
    its own root. Edges with a null end are left out.
    """
    prepare(edges.sparkSession)
    named = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    start = named.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near")).distinct().checkpoint()
    loops, now = start.where("node = near"), start.where("node <> near")
    mark = None
    while True:
        following = _starred(_starred(now, large=True), large=False).checkpoint()
        n, keys = following.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "near"))).first()
        now = following
        if mark == (n, keys):
            break
        mark = (n, keys)
    roots = now.select(F.col("near").alias("node"), F.col("near").alias("root"))
    pairs = now.select("node", F.col("near").alias("root")).unionByName(roots)
    return pairs.unionByName(loops.select("node", F.col("near").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))

"""Connected components of a link table, by alternating star contractions.

A large star points every larger neighbour of a node to the smallest node around it; a small star does the same for the
node and its smaller neighbours. The number of rows never grows, and after a few rounds each component is one star.
Every round is written to the shared folder, so lineage stays short and a lost executor costs one round; the round
before is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollforge.sources.scratch import remove, written


def _settled(edges: DataFrame) -> bool:
    """Whether every u points to one v, and no v points on."""
    several = edges.groupBy("u").count().where("count > 1").select("u")
    roots = edges.select(F.col("v").alias("root")).distinct()
    onward = edges.hint("merge").join(roots.hint("merge"), F.col("u") == F.col("root"), "left_semi").select("u")
    return several.unionByName(onward).isEmpty()


def _star(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (u, v): every v, and u, below the smallest of u's star. edges gives u's star."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = pairs.hint("merge").join(least.hint("merge"), F.col("u") == F.col("c"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) of every node in links (u long, v long); links to itself are left out."""
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        around = both(edges)
        large = _star(around, around.where("v > u")).where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        small = _star(large, large).union(large.groupBy("u").agg(F.min("v")))
        before, edges = edges, written(small.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        remove(before)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

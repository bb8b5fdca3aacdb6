"""Connected components of a table of links, by alternating star steps.

Every step is a group-by with a minimum (combined before the shuffle) and an equi-join of the links with these minima.
The minima are stored first: a join with a scan doesn't take over the partitioning of the group-by, so adaptive skew
handling splits the links of the centre of a large star. Each round is cut with checkpoint() in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_root, stored

#: Links in one file, about: tables of few links are not written in a file for each shuffle partition. Without Hadoop's native
#: library Spark starts processes for every file that it writes.
FILE_LINKS = 100_000


def _in_files(rows: DataFrame, parts: int | None) -> DataFrame:
    return rows.coalesce(parts) if parts else rows


def _large_star(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Links each neighbour above a node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(_in_files(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), parts), "stars")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Links the smaller neighbours of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(_in_files(down.groupBy("u").agg(F.min("v").alias("m")), parts), "stars")
    linked = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs, in any order and with repeats → ``(node, root)`` for every node with a link.

    ``root`` is the component's smallest node. Links of a node to itself and links with nulls are ignored;
    no links give no rows.
    """
    shared_root(edges.sparkSession)
    least = edges.sparkSession.sparkContext.defaultParallelism
    edges = edges.select("u", "v").filter("u != v").distinct().checkpoint()
    before, n = None, edges.count()
    for _ in range(max_rounds):
        # a round has no more links than the one before and one for each node
        parts = max(least, -(-n // FILE_LINKS))
        edges = _in_files(_small_star(_large_star(edges, parts), parts).distinct(), parts).checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before, n = state, state[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

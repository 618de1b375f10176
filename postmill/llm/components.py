"""Connected components of a graph of longs by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the vertex.  The minima are written first, so that the join has plain
exchanges on both sides and a vertex with very many neighbours can be split; no neighbourhood is gathered.  The number
of rounds grows with the logarithm of the graph's size; after ``ROUNDS`` of them, which no graph that fits on disks
needs, the job fails rather than give unfinished components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import partitions, saved

ROUNDS = 100
#: Rows of one partition of a step; a small graph is not dealt over more partitions than it has use for.
ROWS = 100_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts))
    moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of ``edges`` (u, v): root is the smallest vertex that it can reach.

    Edges are undirected; loops, repeated edges and edges with a null end are left out, so a vertex that has
    only such edges is not in the result.
    """
    edges = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # steps have at most twice the rows of the edges, and never more
    parts = max(1, min(2 * partitions(edges.sparkSession), -(-edges.count() // ROWS)))
    edges, mark = edges.coalesce(parts), None
    for _ in range(ROUNDS):
        edges = saved(_small_star(_large_star(edges, parts), parts).coalesce(parts))
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (row["n"], row["h"]) or not row["n"]:
            break
        mark = (row["n"], row["h"])
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

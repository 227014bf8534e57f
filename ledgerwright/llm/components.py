"""Connected components of a graph of long node ids, by alternating star contractions.

Each round rewires every node to the smallest node it knows (first among all its
neighbours, then among its smaller ones), so paths of any length fold up in a
logarithmic number of rounds. All rounds are joins and aggregations of edge rows;
only one row of counters reaches the driver. Edges are written to the reliable
checkpoint folder after each round, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """For each u the smaller of u and its smallest neighbour; the partial sums take care of hubs."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_smallest(down), "u")
    return joined.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u long, v long), component its smallest reachable node.

    Null ends, loops, repeated and turned edges are allowed and change nothing;
    no edges give no rows. Nodes without an edge are not listed.
    """
    state = stored(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:  # a round that changes anything gives a node a smaller neighbour, so rounds end
        state = stored(_small_star(_large_star(state)), "edges")
        mark = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (mark["n"], mark["x"]) == before or not mark["n"]:
            break
        before = (mark["n"], mark["x"])
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Connected components of an edge list by alternating large-star and small-star steps.

Defined results: loops and repeated edges change nothing, nor does an edge's direction; an edge with a null end is
dropped; an empty table has no components; other columns, whatever their names, are not read.  Each node's least
neighbour is an aggregate, combined before its shuffle, and goes to a table before the join with the edges; so that join has plain shuffles, or none, on
both sides, and Spark can split a centre that very many edges share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyspark.llm.scratch import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "components-least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "components-least")
    moved = edges.join(least, "a")
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges in a table of the shared folder, and their number and checksum, taken as they are written."""
    seen = Observation()
    table = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "components")
    return table, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of an edge with the least node of its component.

    Nodes are longs.  Each round ends in a table of the shared folder; the loop ends when a
    round changes no edge, which takes about the logarithm of the longest path in rounds.
    Only counts and checksums reach the driver.
    """
    now, mark = _written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    while mark[0]:
        new, before = _written(_small_star(stored(_large_star(now), "components-large"))), mark
        now, mark = new
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

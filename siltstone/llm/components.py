"""Connected components of an edge table, by alternating large-star and small-star steps.

Nothing is gathered on the driver but whether the edges have become stars. A hub of any degree is safe: its least neighbour is
found by a partial aggregate, and the join that brings it back is a plain equi-join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import materialize, release


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached. Edges from a node to
    itself, repeated edges and both directions are fine; rows with a null end are dropped. No edges, no rows."""
    pairs = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = materialize(pairs.distinct(), "edges")
    nodes = pairs.where("u = v")
    first = current = pairs.where("u <> v")
    for _ in range(max_rounds):
        if _settled(current):
            break
        before, current = current, materialize(_small_star(_large_star(current)), "edges")
        if before is not first:
            release(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("u"), "v").distinct()
    return current.unionByName(roots).unionByName(nodes).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), v below u, are stars: every u has one v, and no v is a u."""
    return edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()

"""Connected components by alternating large-star and small-star steps.

Only edge tables move; each step is one aggregation per node, which combines before the shuffle, and a join with
the nodes that change, of which Spark may split hot ones. Each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, written


def components(edges: DataFrame, within: Scratch | None = None) -> DataFrame:
    """A written table of node, component: of every node of the edges (a, b), the least node it reaches. Null ends and
    loops are ignored; an empty table gives no rows. Rounds grow with the logarithm of the longest path. The table
    belongs to `within`, if given."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.written(pairs.distinct(), "edges")
        state = _state(now)
        while True:
            now = scratch.written(_large_star(now, scratch), "edges")
            now = scratch.written(_small_star(now, scratch), "edges")
            then, state = state, _state(now)
            if then == state:
                break
        roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
        found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        return within.written(found, "components") if within else written(found, "components")


def _state(edges: DataFrame) -> tuple:
    """Tells edge tables apart: their number of rows and two sums of hashes."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).collect()[0]
    return row["n"], row["s"], row["x"]


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour, if that is less than the node.

    Only nodes between a smaller and a larger neighbour move anything. They are written first, so the join has
    them as a table of known size and Spark can split a hot node's edges.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    between = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")).where("m < u AND x > u")
    moved = scratch.written(between.select(F.col("u").alias("b"), "m"), "moved")
    return edges.join(moved, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """A node with several smaller neighbours keeps the least, and the others move there."""
    several = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).where("n > 1")
    several = scratch.written(several.select("a", "m"), "several")
    stays = F.col("m").isNull() | (F.col("b") == F.col("m"))
    moved = edges.join(several, "a", "left").select(F.when(stays, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(stays, F.col("b")).otherwise(F.col("m")).alias("b"))
    return moved.distinct()

"""Fixpoints over edge tables: reachability, topological levels. Frontiers are tables; only their emptiness reaches the driver."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CycleError(ValueError):
    pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder, so that a loop's plan doesn't grow and a lost executor costs nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def closure(seeds: DataFrame, edges: DataFrame, most_levels: int = 1000) -> DataFrame:
    """(origin, node, level) of all nodes reachable from seeds (origin, node) over edges (src, dst); level is the least number of steps."""
    seen = cut(seeds.select("origin", "node").distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for level in range(1, most_levels + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["origin", "node"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError(f"more than {most_levels} levels")


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): dependencies (edges src needs dst) have lower levels; a cycle is an error."""
    left, level, done = cut(nodes.select("node").distinct()), 0, None
    open_edges = edges.join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").join(left.withColumnRenamed("node", "src"), "src", "left_semi")
    open_edges = cut(open_edges.select("src", "dst").distinct())
    while not left.isEmpty():
        free = cut(left.join(open_edges.select(F.col("src").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            raise CycleError("the nodes that are left wait for each other")
        done = free if done is None else cut(done.unionByName(free))
        gone = free.select("node")
        left = cut(left.join(gone, "node", "left_anti"))
        open_edges = cut(open_edges.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        level += 1
    return done if done is not None else nodes.select("node", F.lit(0).alias("level")).limit(0)


def affected(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes to work on again when ``changed`` (node) are: themselves and what needs them, over edges src needs dst."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(changed.select(F.lit(0).alias("origin"), "node"), back).select("node")

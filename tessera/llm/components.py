"""Connected components of a graph too large for one machine, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: longs); root is the component's smallest node.

    Each round links every node's larger neighbours to the smallest of its neighbourhood, then each
    node's smaller neighbours likewise, over edges held once in a stored table; rounds end when
    nothing changes. Nulls are no nodes: an edge with one is left out. A node with many neighbours is met by partial aggregation, and by joins of stored tables, which adaptive execution can split.
    """
    pairs = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        drop_stored(least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        met = large.join(least, "u")
        small = met.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        after = stored(small.distinct(), "links")
        same = after.count() == pairs.count() and after.join(pairs, ["u", "v"], "left_anti").isEmpty()
        drop_stored(least)
        drop_stored(large)
        drop_stored(pairs)
        pairs = after
        if same:
            break
    else:
        raise RuntimeError(f"components need more than {most_rounds} rounds")
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._tessera_path = pairs._tessera_path  # for drop_stored
    return out

"""Connected components of an edge list by repeated contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.shared import cut


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v of one orderable type); comp is the least
    node of the component.

    Each round points every node at its least neighbour, itself included, and contracts the
    edges. A node with neighbours of its component left merges in every round or is merged
    into, so that the nodes at least halve. Rounds end in written tables, and the only thing
    the driver reads is whether an edge is left. Nodes with many edges are reduced before the
    shuffle by the partial minimum."""
    left = cut(edges.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    whole = cut(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("comp", F.col("node")))
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("from"), F.least("u", "v").alias("to"))
        # a chain of pointers is followed one more step, which halves its length
        further = least.select(F.col("from").alias("to"), F.col("to").alias("next"))
        jump = cut(least.join(further, "to").select("from", F.col("next").alias("to")))
        end = jump.select(F.col("from").alias("u"), F.col("to").alias("pu"))
        other = jump.select(F.col("from").alias("v"), F.col("to").alias("pv"))
        moved = left.join(end, "u").join(other, "v").filter(F.col("pu") != F.col("pv"))
        left = cut(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        step = jump.select(F.col("from").alias("comp"), "to")
        whole = cut(whole.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
    return whole

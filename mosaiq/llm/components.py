"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges(a, b) of any orderable type; root is the smallest node that is reachable.

    Alternates large-star and small-star steps: a step replaces the edges of
    each node by edges to its smallest neighbour, which is a grouped minimum
    and a join on the node. Few steps are needed (about the logarithm of the
    longest path); each is written to the checkpoint folder, so the plan stays
    short and a lost executor costs one step. Nulls and loops are left out.
    """
    now = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        now = cut(small)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
        before = mark
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(now.select("b", "b").distinct())

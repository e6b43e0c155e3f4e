"""Connected components of a graph that is larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): nodes have one root if and only if they are connected.

    Contraction: every node goes to the neighbour with the least hash, if that is less than its own; edges are carried
    over to where their ends went and those that became loops go. The hash order is random to the data, so long chains
    shrink by a constant share in each round. Only least values are gathered per node, so a node with any number of
    neighbours is no heavy task. Each round is written to the shared folder, which cuts the lineage.

    Null ends, loops and repeated edges are ignored; an empty table gives an empty result.
    """
    left = staged(
        edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    moves = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))).alias("best"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        move = staged(best.select(F.col("a").alias("old"), F.least(own, F.col("best"))["b"].alias("new")))
        moves.append(move)
        first = left.join(move, left["a"] == move["old"]).select(F.col("new").alias("p"), "b")
        second = first.join(move, first["b"] == move["old"]).select("p", F.col("new").alias("q"))
        left = staged(second.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    at = nodes.withColumn("root", F.col("node"))
    for move in moves:
        at = at.join(move, at["root"] == move["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    return at

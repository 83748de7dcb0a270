"""Connected components by alternating large-star and small-star rounds.

Every round is a pre-aggregated minimum and an equi-join, so the links stay distributed and
a hub with many links costs no task more than its own rows (AQE splits such joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(h, 20)), F.bit_xor(h)).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Self loops and repeated links are harmless, links with a null are none; an empty table gives an
    empty table.  A round's table is deleted as soon as the next one is written.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = scratch.write(edges, "links")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        edges, fresh = scratch.write(_small_star(_large_star(edges)), "links")
        scratch.delete(spark, path)
        before, state, path = state, _state(edges), fresh
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def named(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes(node, least, ..)`` with ``component``: the smallest ``least`` of the node's component in ``found``.

    The names are written before they are joined, so that the join, not knowing an aggregate, may
    broadcast them by their size or split the rows of a large component.
    """
    found = found.withColumnRenamed("component", "root")
    names = scratch.materialize(nodes.select("node", "least").join(found, "node").groupBy("root").agg(F.min("least").alias("name")), "links")
    rooted = nodes.join(found, "node", "left").join(names, "root", "left")
    return rooted.select(*nodes.columns, F.coalesce("name", "least").alias("component"))

"""Connected components by repeated contraction towards random priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``edges(a, b)``; ``component`` is the smallest id reachable.

    Every round, a node moves to the neighbour (or itself) with the smallest hashed priority, edges
    are renamed and those within a node go. Priorities are random, so chains shrink by a constant
    share each round and the number of rounds is logarithmic. Only tables in the shared folder are
    carried from round to round; the driver sees one count. Self loops and repeated edges are fine.
    A hub's edges meet its one step in a join, which adaptive execution splits where it is skewed.
    """
    nodes = stored(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "cc-nodes")
    moved = nodes.select("id", F.col("id").alias("at"))
    left = stored(edges.filter("a <> b").select("a", "b").distinct(), "cc-edges")
    turn = 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("p"), F.col(c).alias("n"))
        both = left.select(F.col("a").alias("u"), rank("b").alias("r")).union(left.select(F.col("b").alias("u"), rank("a").alias("r")))
        step = both.groupBy("u").agg(F.min("r").alias("r")).select("u", F.least(F.col("r"), rank("u"))["n"].alias("to"))
        step = stored(step, "cc-step")
        moved = stored(moved.join(step, moved["at"] == step["u"], "left").select("id", F.coalesce("to", "at").alias("at")), "cc-moved")
        left = left.join(step.select(F.col("u").alias("a"), F.col("to").alias("a2")), "a").join(step.select(F.col("u").alias("b"), F.col("to").alias("b2")), "b")
        left = left.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a <> b").distinct()
        left = stored(left, "cc-edges")
        turn += 1
    smallest = moved.groupBy("at").agg(F.min("id").alias("component"))
    return moved.join(smallest, "at").select("id", "component")


def extended_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` as of ``connected_components``, of the edges behind ``known`` and ``edges(a, b)``.

    Only what joins two known components, or is new, goes through the rounds.
    """
    name = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"{c}_at"))
    named = edges.join(name("a"), "a", "left").join(name("b"), "b", "left")
    named = named.select(F.coalesce("a_at", "a").alias("a"), F.coalesce("b_at", "b").alias("b"))
    more = connected_components(named).select(F.col("id").alias("at"), F.col("component").alias("to"))
    merged = known.join(more, F.col("component") == F.col("at"), "full").select(F.coalesce("id", "at").alias("id"), F.coalesce("to", "component").alias("component"))
    return stored(merged, "cc-extended")

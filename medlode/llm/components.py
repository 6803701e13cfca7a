"""Connected components of an edge table, by alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlode.llm.common import stash


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """From edges (a, b) of longs: each node with the least node of its component, as (node, root).

    Minima are written before they are joined: then both sides of a join are dealt anew, and a node with very
    many neighbours can be split among tasks. Each round hooks the larger neighbours of every node to its least neighbour, then the smaller ones; the
    longest path shrinks by a factor each time. Rounds end when no edge changes.
    """
    now = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    for _ in range(rounds):
        # large star: neighbours above a node go to the least of its neighbours and itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        above = stash(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct(), "above")
        # small star: neighbours below a node, and it, go to the least of them
        least = stash(above.groupBy("b").agg(F.min("a").alias("m")), "least")
        down = above.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
        now = stash(down.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))

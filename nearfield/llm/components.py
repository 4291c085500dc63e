"""Connected components of a graph given as edges, without collecting it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import spill


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from id, for every id of the edges (a, b); self-loops keep single vertices.

    Contraction: every vertex takes the label of the least vertex next to it, and the edges between labels are the next
    graph, until there are none. Ids in arbitrary order leave about a third of the vertices each time, so the number of
    rounds grows with the logarithm of the graph's. The least vertex of a component keeps its label, so the last label
    is the smallest id. Labels are joined from written tables, whose sizes are known, so small ones are broadcast and
    large ones sorted, where skewed vertices are split.
    """
    e = spill(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), "cc")
    label = None
    for _ in range(rounds):
        ends = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = spill(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least")
        if label is None:
            label = least.select(F.col("a").alias("id"), F.col("m").alias("component"))
        else:
            step = least.select(F.col("a").alias("component"), "m")
            label = label.join(step, "component", "left").select("id", F.coalesce("m", "component").alias("component"))
        left = e.join(least.withColumnRenamed("m", "x"), "a").select("b", "x").join(least.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        e = spill(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc")
        if not e.head(1):
            return spill(label, "components")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0 .. n - 1 is connected to."""
    up = np.arange(n)
    while True:
        least = up.copy()
        np.minimum.at(least, i, up[j])
        np.minimum.at(least, j, up[i])
        least = least[least]
        if (least == up).all():
            return up
        up = least

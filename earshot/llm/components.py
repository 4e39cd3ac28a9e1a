"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that links reach.

    Loops and null ends are ignored, repeated edges count once, an empty list gives an empty table. Each round joins
    edges with the smallest neighbour of one end: sums are partial before the shuffle, and joins may split a hot end.
    """
    ends = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = saved(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        middle = saved(large)
        least = middle.groupBy("u").agg(F.min("v").alias("m"))
        small = middle.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(middle)
        before, state = state, _state(new)
        discard(now)
        now = new
        if before == state:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple:
    """Edge count and an order-free sum of edge hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that links a-b reach from each of n indices."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root

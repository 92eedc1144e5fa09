"""Connected components of an edge table by alternating large and small stars.

Every round is a pair of key aggregations (with partial minima before the shuffle) and joins on
the same key. A join's tasks stream a node's edges and hold one row a node; a hub's edges meet in
one task unless Spark's adaptive skew join splits them. Each round's edges are a written table.
Nothing but two numbers a round comes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewatt.llm import runtime


def local_stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:  # jump to the label's label
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        live = label[a] != label[b]
        a, b = a[live], b[live]
        if not len(a) or (label == before).all():
            break
    return label


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to ``(node, component)``: each node that has an edge, and the smallest
    node it can reach. Loops, repeated edges and either direction are fine; nulls are dropped.
    """
    spark = edges.sparkSession
    held, path = runtime.materialize(
        edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = signature(held)
    while before[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minima(both).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = _minima(large)
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")
        both = small.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        then, new = runtime.materialize(both, "edges")
        now = signature(then)
        runtime.remove(spark, path)
        held, path = then, new
        if now == before:
            break
        before = now
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

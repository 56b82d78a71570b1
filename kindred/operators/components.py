"""Connected components: edges shrink to a forest inside every partition, then labels spread over what is left."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.scratch import Scratch


#: Links that one task may join; a fixed bound, some 100 MB of Python objects.
ONE_TASK = 500_000


def _forest(edges: DataFrame) -> DataFrame:
    """(x, y): in every partition each node with the smallest node that the partition's edges join it with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def top(n):
            path = []
            while (m := up.setdefault(n, n)) != n:
                path.append(n)
                n = m
            for x in path:
                up[x] = n
            return n

        for b in batches:
            for x, y in zip(b["x"], b["y"]):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        links = [(n, top(n)) for n in list(up)]
        yield pd.DataFrame([(n, t) for n, t in links if n != t], columns=["x", "y"])

    return edges.mapInPandas(run, edges.schema)


def connected_components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None, node: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) where component is the smallest node. ``nodes`` adds records without edges.

    First every partition replaces its edges by links from each node to the smallest one it reaches there; no shuffle is needed, and what
    is left has fewer edges than the partitions have nodes. Up to ONE_TASK links are finished the same way in one task. A round over more takes the smallest label among a node and its neighbours (combined before the shuffle), then lets every label jump to
    its own label, so long chains shrink by halves. States are written tables; the loop ends when no label moves. Edges with a
    null end are ignored.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    few = scratch.cut(_forest(e))
    if few.limit(ONE_TASK + 1).count() <= ONE_TASK:
        stars = scratch.cut(_forest(few.coalesce(1)))
        roots = stars.select(F.col("y").alias("node")).distinct()
        return _with_nodes(stars.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(roots.withColumn("component", F.col("node"))), nodes, node)
    both = scratch.cut(few.unionByName(few.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    now = scratch.cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    while True:
        labels = now.select(F.col("node").alias("y"), F.col("label").alias("l"))
        seen = both.join(labels, "y").groupBy("x").agg(F.min("l").alias("l"))
        step = now.join(seen.withColumnRenamed("x", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        step = scratch.cut(step)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
        new = scratch.cut(step.join(jump, "label").select("node", "old", F.least("label", "to").alias("label")))
        moved = new.where("old <> label").limit(1).count()
        scratch.drop(now, step)
        now = new
        if not moved:
            break
    return _with_nodes(now.select("node", F.col("label").alias("component")), nodes, node)


def _with_nodes(found: DataFrame, nodes: DataFrame | None, node: str | None) -> DataFrame:
    if nodes is None:
        return found
    every = nodes.select(F.col(node).alias("node")).where("node is not null").distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

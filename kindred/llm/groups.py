"""Groups from pairwise links by deterministic Borůvka hooking (problem 1).

Each round every component takes its smallest outgoing edge. Edges are ordered by (smaller end, larger end), so a component's
smallest edge is the one to its smallest neighbour, two components that choose each other share one edge, and the chosen edges
form trees. A tree's root is the smaller of its mutual pair; pointer doubling sends every node to its root; the edges are then
relabelled, self loops and repeats fall away, and the next round runs on what is left. A round at least halves the components
that still have edges, so a chain of a billion records needs about thirty rounds at worst and far fewer as a rule.

Shuffles hold one row per edge or node. Minima are combined before the shuffle, so a hub's edges cost nothing there; in the lookups a
hub's edges, and the nodes of a giant tree, are salted and meet repeated rows of the table with one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.scratch import Scratch
from kindred.skew import lookup_counted


def _roots(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(node, root) of one hooking round: all nodes of edges, each with the root of its tree; and how many nodes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.node", "e.to")
    hook = scratch.cut(ends.groupBy("node").agg(F.min("to").alias("to")))
    n = hook.count()  # every lookup keeps the rows, so they are counted once
    back = hook.select(F.col("node").alias("to"), F.col("to").alias("back"))
    # the smaller node of a mutual pair is the root; two steps are taken at once
    now = scratch.cut(
        lookup_counted(hook, back, "to", "node", total=n).select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("root"))
    )
    scratch.drop(hook)
    while True:
        step = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = scratch.cut(lookup_counted(now, step, "root", "node", total=n).select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        scratch.drop(now)
        now = new
        if not moved:
            return now, n


def components(edges: DataFrame, a: str, b: str, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node of the edges; root is the smallest node of its component.

    Edges with a null end and self loops link nothing, but a self loop's node is not listed either: callers add unlinked nodes
    themselves. Repeated edges and either direction are the same edge. No edges give an empty table.
    """
    scratch = scratch or Scratch(edges.sparkSession, "groups")
    left, right = F.col(a), F.col(b)
    now = scratch.cut(edges.where(left.isNotNull() & right.isNotNull() & (left != right)).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct())
    rounds: list[tuple[DataFrame, int]] = []
    while total := now.count():
        roots, n = _roots(now, scratch)
        rounds.append((roots, n))
        ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        new = scratch.cut(
            lookup_counted(lookup_counted(now, ra, "a", "b", total=total), rb, "b", "a", counted=now, total=total).where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        scratch.drop(now)
        now = new
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out, n = rounds.pop()
    out = out.select("node", "root")
    while rounds:
        above = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        below, n = rounds.pop()
        out = lookup_counted(below.select("node", "root"), above, "root", "node", "left", total=n).select("node", F.coalesce("top", "root").alias("root"))
        out = scratch.cut(out)
    # a tree's root is the smaller of one pair, not always the smallest node of the whole component
    least = out.groupBy("root").agg(F.min("node").alias("least"))
    return lookup_counted(out, least, "root", "node", total=n).select("node", F.col("least").alias("root"))


def group_ids(pairs: DataFrame, left: str, right: str, p: str, threshold: float, members: DataFrame, member: str, cluster: str) -> DataFrame:
    """(id, group_id) for every id of either table.

    pairs link when any of their rows has a number p >= threshold (null and NaN are no numbers); two members link when they
    share a cluster. A cluster is a node of its own, so a cluster of millions costs one edge a member and never its pairs.
    Null ids are no records and are left out; a null cluster links nothing. group_id is the group's smallest id, an unlinked
    record's own id. Repeated rows change nothing; empty tables give an empty result; other columns are ignored.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    l, r, m = (F.col(x).cast("string") for x in (left, right, member))
    strong = pairs.where((F.col(p) >= threshold) & ~F.isnan(F.col(p).cast("double")))
    # the prefix keeps records before clusters, so the smallest node of a group is a record
    edges = strong.select(F.concat(F.lit("0"), l).alias("a"), F.concat(F.lit("0"), r).alias("b")).unionByName(
        members.where(m.isNotNull() & F.col(cluster).isNotNull()).select(F.concat(F.lit("0"), m).alias("a"), F.concat(F.lit("1"), F.col(cluster).cast("string")).alias("b"))
    )
    ids = pairs.select(F.explode(F.array(l, r)).alias("id")).unionByName(members.select(m.alias("id"))).where("id is not null").distinct()
    found = components(edges, "a", "b", scratch).where(F.col("node").startswith("0")).select(F.expr("substr(node, 2)").alias("id"), F.expr("substr(root, 2)").alias("root"))
    return ids.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("group_id"))

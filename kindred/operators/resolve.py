"""Links from scores: cardinality rules, ambiguity margins and optimal assignment."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.assignment import assign
from kindred.operators.components import connected_components
from kindred.scratch import Scratch
from kindred.skew import lookup_counted

HOW = ("many-to-many", "many-to-one", "one-to-many", "one-to-one")
#: A component with more records on a side is matched greedily, with a warning; resolve() takes another limit as ``side_limit``.
SIDE_LIMIT = 2000
#: Pairs of small components that one task takes together.
PACK = 5_000


def number(value: object, label: str, probability: bool = False) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")):
        raise ValueError(f"`{label}` is no finite number")
    if probability and not 0 <= value <= 1:
        raise ValueError(f"`{label}` must lie between 0 and 1")
    return float(value)


def probability(c: Column) -> Column:
    """p as a number or null: NaN sorts above all numbers in Spark, so it is taken out first."""
    return F.when(~F.isnan(c), c)


def check_scores(scores: DataFrame) -> None:
    """One aggregation: no null or repeated pairs, p in [0, 1] or null, sim in [0, 1]."""
    r = scores.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("left_id").isNull() | F.col("right_id").isNull(), 1)).alias("null_ids"),
        F.count(F.when((F.col("p") < 0) | (probability(F.col("p")) > 1), 1)).alias("bad_p"), F.count(F.when(F.col("sim").isNull() | F.isnan("sim") | (F.col("sim") < 0) | (F.col("sim") > 1), 1)).alias("bad_sim"),
    ).first()
    if r["null_ids"]:
        raise ValueError("scores have missing IDs")
    if r["bad_p"]:
        raise ValueError("some p lies outside 0 and 1")
    if r["bad_sim"]:
        raise ValueError("some sim is missing or outside 0 and 1")
    if scores.groupBy("left_id", "right_id").count().where("count > 1").limit(1).count():
        raise ValueError("scores repeat a pair")


def with_margin(scores: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Adds margin: p minus the best p of another row with the same left or right record; null without one. Rows without p never
    compete.

    Each side's two best values are aggregated, combined before the shuffle, and looked up, so a record with millions of pairs is
    never sorted in one task. The scores are written once and read from there, so the plan stays small whatever they come from."""
    written = (scratch or Scratch(scores.sparkSession, "margin")).kept(scores)
    s, total = written.withColumn("p", probability(F.col("p").cast("double"))), written.count()

    def best(side: str) -> DataFrame:
        by_p = s.where("p is not null").groupBy(side, "p").agg(F.count(F.lit(1)).alias("n"))
        top = by_p.groupBy(side).agg(F.max(F.struct("p", "n")).alias("top"))
        second = by_p.join(top, side).where(F.col("p") < F.col("top.p")).groupBy(side).agg(F.max("p").alias("second"))
        return top.join(second, side, "left").select(side, F.col("top.p").alias("_p1"), F.col("top.n").alias("_n1"), F.col("second").alias("_p2"))

    def rival(prefix: str) -> Column:
        p1, n1, p2 = (F.col(f"{prefix}{c}") for c in ("_p1", "_n1", "_p2"))
        return F.when(F.col("p").isNull(), None).when((F.col("p") == p1) & (n1 == 1), p2).otherwise(p1)

    met = s
    for side, prefix in (("left_id", "l"), ("right_id", "r")):
        met = lookup_counted(met, best(side).withColumnsRenamed({c: prefix + c for c in ("_p1", "_n1", "_p2")}), side, "right_id" if side == "left_id" else "left_id", "left", written, total)
    met = met.withColumn("margin", F.col("p") - F.greatest(rival("l"), rival("r")))
    return met.select(*scores.columns, "margin")


def _greedy(edges: list[tuple]) -> list[int]:
    used_l, used_r, out = set(), set(), []
    for i in sorted(range(len(edges)), key=lambda i: (-edges[i][2], -edges[i][3], edges[i][0], edges[i][1])):
        if edges[i][0] not in used_l and edges[i][1] not in used_r:
            used_l.add(edges[i][0])
            used_r.add(edges[i][1])
            out.append(i)
    return out


def match_component(edges: list[tuple], limit: int = SIDE_LIMIT) -> list[int]:
    """Indices of the matched pairs of one component. A component of one pair or a star needs no search."""
    lefts, rights = {e[0] for e in edges}, {e[1] for e in edges}
    if len(lefts) == 1 or len(rights) == 1:
        return [min(range(len(edges)), key=lambda i: (-edges[i][2], -edges[i][3], edges[i][0], edges[i][1]))]
    if max(len(lefts), len(rights)) > limit:
        warnings.warn(f"a component has more than {limit} records on a side; its pairs were matched greedily", RuntimeWarning, stacklevel=2)
        return _greedy(edges)
    return assign(edges)


def packs(pairs: int) -> int:
    """How many tasks' worth of components there are: packs grow with the data, so a pack stays near PACK pairs."""
    return max(1, -(-pairs // PACK))


def _one_to_one(strong: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """(left_id, right_id) of the assignment. Pairs whose two records meet in no other pair are settled in the JVM; small components
    are packed, about PACK pairs together, and solved one after the other inside a pack."""
    deg_l, deg_r = strong.groupBy("left_id").agg(F.count(F.lit(1)).alias("_dl")), strong.groupBy("right_id").agg(F.count(F.lit(1)).alias("_dr"))
    s = scratch.cut(strong.join(deg_l, "left_id").join(deg_r, "right_id").select("left_id", "right_id", "p", "sim", "_dl", "_dr"))
    alone = s.where("_dl = 1 and _dr = 1").select("left_id", "right_id")
    hard = s.where("_dl > 1 or _dr > 1")
    ends = hard.select(F.concat(F.lit("l"), F.col("left_id").cast("string")).alias("a"), F.concat(F.lit("r"), F.col("right_id").cast("string")).alias("b"), "left_id", "right_id", "p", "sim")
    comp = connected_components(ends, "a", "b", scratch=scratch)
    member = ends.join(comp.withColumnRenamed("node", "a"), "a").select("left_id", "right_id", "p", "sim", "component")
    # a component with more than ``limit`` records on a side takes locally best pairs instead, without being gathered
    size = member.groupBy("component").agg(F.count_distinct("left_id").alias("nl"), F.count_distinct("right_id").alias("nr"))
    member = scratch.cut(member.join(size, "component").withColumn("big", F.greatest("nl", "nr") > limit).drop("nl", "nr"))
    kinds = {c: hard.schema[c].dataType.simpleString() for c in ("left_id", "right_id")}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("component", sort=True):
            edges = list(zip(part["left_id"], part["right_id"], part["p"], part["sim"]))
            out += [edges[i][:2] for i in match_component(edges, limit)]
        return pd.DataFrame(out, columns=["left_id", "right_id"])

    small, large = member.agg(F.count(F.when(~F.col("big"), 1)), F.count(F.when(F.col("big"), 1))).first()
    exact = member.where("not big").withColumn("_b", F.pmod(F.xxhash64("component"), F.lit(packs(small))))
    found = alone.unionByName(exact.groupBy("_b").applyInPandas(solve, f"left_id {kinds['left_id']}, right_id {kinds['right_id']}"))
    if not large:
        return found
    warnings.warn(f"a component has more than {limit} records on a side; its pairs were matched greedily", RuntimeWarning, stacklevel=3)
    return found.unionByName(greedy_matching(member.where("big"), scratch))


def greedy_matching(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The greedy matching in rounds: a pair that is the best of both its records is taken, and both leave. Equal to taking pairs one
    by one in the order (p desc, sim desc, left_id, right_id)."""
    code = F.struct((-F.col("p")).alias("p"), (-F.col("sim")).alias("s"), F.col("left_id").alias("l"), F.col("right_id").alias("r"))
    left, taken = scratch.cut(pairs.select("left_id", "right_id", "p", "sim")), []
    while left.limit(1).count():
        coded = left.withColumn("_c", code)
        bl, br = coded.groupBy("left_id").agg(F.min("_c").alias("_bl")), coded.groupBy("right_id").agg(F.min("_c").alias("_br"))
        best = scratch.cut(bl.select(F.col("_bl").alias("_c")).join(br.select(F.col("_br").alias("_c")), "_c").select(F.col("_c.l").alias("left_id"), F.col("_c.r").alias("right_id")))
        taken.append(best)
        left = scratch.cut(left.join(best.select("left_id"), "left_id", "left_anti").join(best.select("right_id"), "right_id", "left_anti"))
    out = pairs.select("left_id", "right_id").limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out


def resolve(scores: DataFrame, *, how: str = "one-to-one", threshold: float = 0.5, min_margin: float | None = None, check: bool = True, side_limit: int = SIDE_LIMIT, scratch: Scratch | None = None) -> DataFrame:
    """Links under a cardinality rule: the scored pairs with p >= threshold that the rule keeps, with their margin over all scored pairs.

    many-to-many keeps all, many-to-one the best right of each left, one-to-many the best left of each right, by (p desc, sim desc,
    IDs); one-to-one maximises the sum of p, then of sim, then prefers the earliest pairs; components of more than ``side_limit``
    records on a side are matched greedily, with a warning. The margin filter runs after assignment and nothing is matched again; a
    null margin passes. ``check`` refuses missing IDs, repeated pairs and numbers out of range (two aggregations).
    """
    if how not in HOW:
        raise ValueError(f"`how` must be one of {', '.join(HOW)}; got {how!r}")
    threshold = number(threshold, "threshold", True)
    scratch = scratch or Scratch(scores.sparkSession, "resolve")
    scores = scratch.kept(scores)
    if check:
        check_scores(scores)
    s = with_margin(scores, scratch)
    strong = s.where(F.col("p") >= threshold)
    if how == "one-to-one":
        strong = scratch.cut(strong)
        strong = strong.join(_one_to_one(strong, scratch, side_limit), ["left_id", "right_id"])
    elif how != "many-to-many":
        side = "left_id" if how == "many-to-one" else "right_id"
        w = Window.partitionBy(side).orderBy(F.desc("p"), F.desc("sim"), "left_id", "right_id")
        strong = strong.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    if min_margin is not None:
        strong = strong.where(F.col("margin").isNull() | (F.col("margin") >= number(min_margin, "min_margin")))
    return strong


def ordered(links: DataFrame) -> DataFrame:
    return links.orderBy(F.desc("p"), "left_id", "right_id")

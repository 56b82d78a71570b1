"""Linkage of two tables without keys by soft logic (problem 2).

Each candidate pair of groups (A of the one table, B of the other) has a truth value y in [0, 1], the confidence of the match.
Weighted rules speak about it, each a hinge loss that is nought while the rule holds:

* similarity: every pair of spellings of A and B wants y to reach its own likeness s,   w_s * max(0, s - y)
* prior: most pairs are no match,                                                       w_p * y
* transitivity: spellings linked within a table are one group, so what holds for one pair of spellings holds for all: they
  share the one value y, and each puts its loss on it
* exclusivity: a group has one counterpart, over the values of its options,             w_x * max(0, sum(c * y) - 1)

The sum is convex and is minimised by the alternating direction method of multipliers: similarity, exclusivity of A and
exclusivity of B each keep a copy of y and solve their own part in closed form, then the copies are averaged and the
multipliers move. Pairs without a rival are solved at once; only contested pairs iterate. An iteration is two sums and
two lookups over the contested pairs. Contested pairs that share no group, directly or by others, do not touch each other: each
component iterates until it has settled by itself and then leaves the iterations. Components of up to SMALL pairs are put
together in batches and iterate within a task; only larger ones take the same iterations as tables, and are gathered nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.entities import candidates, entities, near_cities, near_stems, prepare
from kindred.llm.groups import components
from kindred.scratch import Scratch

W_SIMILAR, W_PRIOR, W_EXCLUSIVE, RHO = 1.0, 0.3, 3.0, 2.0
#: A component's iterations end when neither the values nor the copies' disagreement exceed SETTLED. ROUNDS is only a guard: it raises.
ROUNDS, SETTLED = 1000, 0.01
#: Pairs of a component, and of a batch of them, that one task may hold.
SMALL, BATCH = 5_000, 20_000
#: Likenesses are kept in steps, so a group pair's evidence is a short histogram however many spellings it has.
STEPS = 20
ACCEPT = 0.55


def likeness(name: Column, score: Column) -> Column:
    """How much one pair of spellings speaks for a match, from the names and from what places and years say."""
    return 1 / (1 + F.exp(-(-3.2 + 3.0 * name + 0.6 * score)))


def _solve(hist: np.ndarray, v: np.ndarray | None) -> np.ndarray:
    """The value that minimises the similarity and prior losses, near v (RHO / 2 * (y - v)**2) if v is given."""
    n = hist.sum(1)
    above = np.cumsum(hist[:, ::-1], 1)[:, ::-1] / n[:, None]  # share of likenesses of step k or more
    strength = 1 + np.log(n)
    lo, hi = np.zeros(len(n)), np.ones(len(n))
    for _ in range(20):
        mid = (lo + hi) / 2
        step = np.minimum((mid * STEPS).astype(int), STEPS)
        more = np.where(step + 1 < STEPS + 1, np.take_along_axis(np.pad(above, ((0, 0), (0, 2))), (step + 1)[:, None], 1)[:, 0], 0)
        slope = strength * (W_PRIOR - W_SIMILAR * more) + (RHO * (mid - v) if v is not None else 0)
        up = slope < 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def _similar(state: DataFrame, free: bool) -> DataFrame:
    """Adds xs, the copy of the similarity rules."""
    schema = state.drop("xs").schema.add("xs", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = None if free else (b["z"] - b["us"]).to_numpy()
                yield b.drop(columns="xs", errors="ignore").assign(xs=_solve(np.array(b["hist"].to_list(), float), v))[schema.names]

    return state.drop("xs").mapInPandas(run, schema)


def _exclusive(state: DataFrame, side: str, out: str, dual: str, coef: str) -> DataFrame:
    """Adds a copy that gives way where the options of one group together exceed one."""
    v = F.col("z") - F.col(dual)
    sums = state.groupBy(side).agg(F.sum(F.col(coef) * v).alias("_s"), F.sum(F.col(coef) * F.col(coef)).alias("_n"))
    step = F.least(F.lit(W_EXCLUSIVE / RHO), (F.col("_s") - 1) / F.col("_n"))
    return state.join(sums, side).withColumn(out, v - F.when(F.col("_s") > 1, step).otherwise(0.0) * F.col(coef)).drop("_s", "_n")


def _settle(b: pd.DataFrame, rounds: int, settled: float) -> pd.DataFrame:
    """(A, B, confidence) of whole components, iterated as soft_logic() does."""
    out = []
    code = lambda c: pd.factorize(b[c])[0]
    part, sides = code("part"), [(code("A"), b["ca"].to_numpy()), (code("B"), b["cb"].to_numpy())]
    hist, z, at = np.array(b["hist"].to_list(), float), b["z"].to_numpy(), np.arange(len(b))
    duals = np.zeros((3, len(b)))
    for _ in range(rounds):
        copies = [_solve(hist, z - duals[0])]
        for (g, c), u in zip(sides, duals[1:]):
            v = z - u
            total, norm = np.bincount(g, c * v), np.bincount(g, c * c)
            step = np.where(total > 1, np.minimum(W_EXCLUSIVE / RHO, (total - 1) / np.where(norm > 0, norm, 1)), 0.0)
            copies.append(v - step[g] * c)
        copies = np.stack(copies)
        old, z = z, np.clip((copies + duals).mean(0), 0.0, 1.0)
        duals = duals + copies - z
        most = np.zeros(part.max() + 1)
        np.maximum.at(most, part, np.abs(z - np.vstack([old, copies])).max(0))
        live = (most >= settled)[part]
        out.append(pd.DataFrame({"A": b["A"].to_numpy()[at[~live]], "B": b["B"].to_numpy()[at[~live]], "confidence": z[~live]}))
        part, sides, hist, z, at, duals = part[live], [(g[live], c[live]) for g, c in sides], hist[live], z[live], at[live], duals[:, live]
        if not len(at):
            return pd.concat(out)
    raise RuntimeError(f"{len(np.unique(part))} groups of contested pairs have not settled after {rounds} rounds")


def soft_logic(pairs: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(A, B, confidence) of group pairs. pairs has A, B, s (likeness of one pair of spellings) and strong.

    Strong options of one group are taken for fragments of one counterpart and count together as one option; a weak option is a
    rival of all others. Null s count as 0. No pairs give no rows. A component unsettled after ``rounds`` raises.
    """
    step = F.least(F.lit(STEPS), F.greatest(F.lit(0), F.round(F.coalesce(F.col("s"), F.lit(0.0)) * STEPS))).cast("int")
    hist = F.array(*[F.count(F.when(F.col("k") == k, 1)).cast("double") for k in range(STEPS + 1)])
    g = pairs.withColumn("k", step).groupBy("A", "B").agg(hist.alias("hist"), F.max("strong").alias("strong"))
    for side, coef in (("A", "ca"), ("B", "cb")):
        n = g.groupBy(side).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("strong").cast("int")).alias("_strong"))
        g = g.join(n, side).withColumn(coef, F.when(F.col("strong"), 1.0 / F.col("_strong")).otherwise(1.0)).withColumn(f"n{coef}", F.col("_n") - F.greatest(F.col("_strong") - 1, F.lit(0))).drop("_n", "_strong")
    start = _similar(g.withColumn("z", F.lit(0.0)), True)
    start = scratch.cut(start.withColumn("z", F.col("xs")))
    contested = F.col("nca") + F.col("ncb") > 2
    done = start.where(~contested).select("A", "B", F.col("z").alias("confidence"))
    state = start.where(contested).withColumns({u: F.lit(0.0) for u in ("us", "ua", "ub")})
    part = components(state.select(F.concat(F.lit("A"), "A").alias("a"), F.concat(F.lit("B"), "B").alias("b")), "a", "b", scratch)
    part = part.where(F.col("node").startswith("A")).select(F.expr("substr(node, 2)").alias("A"), F.col("root").alias("part"))
    state = scratch.cut(state.join(part, "A"))
    big = F.col("_n") > SMALL
    sizes = scratch.cut(state.groupBy("part").agg(F.count(F.lit(1)).alias("_n")))
    few, many = sizes.agg(F.sum(F.when(~big, F.col("_n"))), F.sum(F.when(big, F.col("_n")))).first()
    if few:
        batch = F.pmod(F.xxhash64("part"), F.lit(-(-few // BATCH)))
        small = state.join(sizes.where(~big).select("part"), "part").withColumn("batch", batch).select("A", "B", "ca", "cb", "z", "hist", "part", "batch")
        limit = SETTLED
        done = done.unionByName(scratch.cut(small.groupBy("batch").applyInPandas(lambda b: _settle(b, rounds, limit), done.schema)))
    if not many:
        return done
    state = before = scratch.cut(state.join(sizes.where(big).select("part"), "part"))
    for _ in range(rounds):
        state = _similar(state, False)
        state = _exclusive(_exclusive(state, "A", "xa", "ua", "ca"), "B", "xb", "ub", "cb")
        mean = (F.col("xs") + F.col("us") + F.col("xa") + F.col("ua") + F.col("xb") + F.col("ub")) / 3
        state = state.withColumn("z0", F.col("z")).withColumn("z", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))
        state = state.withColumns({u: F.col(u) + F.col(x) - F.col("z") for u, x in (("us", "xs"), ("ua", "xa"), ("ub", "xb"))})
        state = scratch.cut(state.withColumn("moved", F.greatest(*[F.abs(F.col("z") - F.col(x)) for x in ("z0", "xs", "xa", "xb")])).drop("z0", "xa", "xb"))
        scratch.drop(before)
        moves = state.groupBy("part").agg(F.max("moved").alias("most"))
        settled, left = moves.agg(F.count(F.when(F.col("most") < SETTLED, 1)), F.count(F.when(F.col("most") >= SETTLED, 1))).first()
        before, state = state, state.drop("moved")
        if settled:
            ready = state.join(moves.where(F.col("most") < SETTLED).select("part"), "part")
            done = done.unionByName(scratch.cut(ready.select("A", "B", F.col("z").alias("confidence"))))
            if left:
                state = scratch.cut(state.join(moves.where(F.col("most") >= SETTLED).select("part"), "part"))
                scratch.drop(before)
                before = state
        if not left:
            return done
    raise RuntimeError(f"{left} groups of contested pairs have not settled after {rounds} rounds")


def link(rows: DataFrame, left: str, right: str, scratch: Scratch) -> DataFrame:
    """(left_id, right_id, confidence) of the accepted pairs of rows of two tables in the form of entities.profiles().

    Rows with a null key, and names without words of their own (null, blank, placeholders), match nothing; repeated rows and other
    columns change nothing; an empty side gives no rows.
    """
    keyed, profs = prepare(rows, scratch)
    near, towns = near_stems(profs, scratch), near_cities(profs, scratch)
    inside = scratch.cut(entities(profs, candidates(profs, scratch, near=near, towns=towns), scratch))
    cand = candidates(profs, scratch, (left, right), near, towns)
    a, b = inside.select(F.col("p").alias("pa"), F.col("entity").alias("A")), inside.select(F.col("p").alias("pb"), F.col("entity").alias("B"))
    pairs = cand.join(a, "pa").join(b, "pb").select("A", "B", likeness(F.col("name_sim"), F.col("score")).alias("s"), (F.col("strong") & (F.col("name_sim") >= 0.8)).alias("strong"))
    good = soft_logic(scratch.cut(pairs), scratch).where(F.col("confidence") >= ACCEPT)
    members = keyed.join(inside, "p").select("tab", "id", "entity").distinct()
    l = members.where(F.col("tab") == left).select(F.col("entity").alias("A"), F.col("id").alias("left_id"))
    r = members.where(F.col("tab") == right).select(F.col("entity").alias("B"), F.col("id").alias("right_id"))
    return good.join(l, "A").join(r, "B").select("left_id", "right_id", "confidence")

"""Exact radius joins of strings under the edit distance, by metric-space partitioning (problems 2 and 4).

Every string goes to the cell of its nearest pivot and is repeated in the cells of all pivots that are at most two radii further
away. By the triangle inequality every pair within the radius then meets in the home cell of either string. Inside a cell no
string is compared with all others: of two strings within two edits, the first, middle or last third of the shorter one occurs
unchanged in the longer one at a place off by at most one, so strings meet on equal thirds, and the true edit distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.names import distance
from kindred.scratch import Scratch

#: The most pivots, and the bounded sample they are chosen from; neither changes which pairs are found.
PIVOTS, SAMPLE = 32, 300
REACH = 2
#: Keys of one string in one cell, and what checking one pair costs next to sending one key.
KEYS, CHECK = 12, 0.25


def pivots(strings: DataFrame, col: str, count: int = PIVOTS, sample: int = SAMPLE) -> list[str]:
    """Far-apart strings: each next pivot is the sampled string furthest from the ones before. How many of them are used is what the
    sample says is least work."""
    pool = sorted(r[0] for r in strings.select(col).orderBy(F.xxhash64(col), col).limit(sample).collect())
    if not pool:
        return []
    out = [pool[0]]
    best = [99] * len(pool)
    while len(out) < min(count, len(pool)):
        best = [min(b, distance(x, out[-1], 98)) for b, x in zip(best, pool)]
        far = max(range(len(pool)), key=lambda i: (best[i], pool[i]))
        if best[far] == 0:
            break
        out.append(pool[far])
    return fewest(out, pool, strings.count())


def fewest(ps: list[str], pool: list[str], total: int) -> list[str]:
    """The first of the pivots, as many as give the least work for ``total`` strings like the sample: every further pivot repeats boundary
    strings in more cells, and parts the pairs that share a third."""
    if not ps or total < 2:
        return ps[:1]
    far = [[distance(x, p, 98) for p in ps] for x in pool]
    parts: dict[tuple, list[int]] = {}
    for i, x in enumerate(pool):
        n = len(x)
        for k, t in enumerate((x[: n // 3], x[n // 3 : n * 2 // 3], x[n * 2 // 3 :])):
            parts.setdefault((n, k, t), []).append(i)
    met = [(i, j) for rows in parts.values() for i in rows for j in rows if i != j]
    best = None
    for count in sorted({c for c in (1, 2, 4, 8, 16, len(ps)) if c <= len(ps)}):
        cells = [{k for k in range(count) if d[k] <= min(d[:count]) + 2 * REACH} for d in far]
        home = [d.index(min(d[:count])) for d in far]
        sent = KEYS * sum(map(len, cells)) / len(pool)
        checked = (total / len(pool)) * sum(home[i] in cells[j] for i, j in met) / len(pool)
        if best is None or sent + CHECK * checked < best[0]:
            best = (sent + CHECK * checked, count)
    return ps[: best[1]]


def allowed(a: Column, b: Column, short: int = 7) -> Column:
    """The radius of a pair: one edit under ``short`` letters, else two."""
    return F.when(F.least(F.length(a), F.length(b)) < short, 1).otherwise(REACH)


def _both(met: DataFrame) -> DataFrame:
    """(a, b) and (b, a) of every row, without a second copy of the plan."""
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return met.select(F.explode(turned).alias("_m")).select("_m.a", "_m.b")


def radius_join(strings: DataFrame, col: str, short: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """(a, b) of all pairs of different strings within the radius, in both orders. Null and empty strings pair with nothing.

    The cells of every string are written once: both sides of the join read them, and the driver holds no plan that makes them again."""
    scratch = scratch or Scratch(strings.sparkSession, "metric")
    src = strings.select(F.col(col).alias("s")).where("s is not null and s <> ''").distinct()
    ps = pivots(src, "s")
    if not ps:
        return src.select(F.col("s").alias("a"), F.col("s").alias("b")).limit(0)
    # a string becomes some hundred keys: spread the few bytes over all tasks before that, not after
    src = src.repartition(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    far = F.array(*[F.struct(F.levenshtein("s", F.lit(p)).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(ps)])
    home = F.array_min("far")
    cells = F.transform(F.filter("far", lambda x: x["d"] <= home["d"] + 2 * REACH), lambda x: x["i"])
    src = scratch.cut(src.withColumn("far", far).select("s", F.length("s").alias("n"), home["i"].alias("home"), cells.alias("cells")))
    third = lambda n: F.floor(n / 3).cast("int")
    key = lambda n, part, text: F.concat_ws("|", n.cast("string"), F.lit(part), text)
    n, s = F.col("n"), F.col("s")
    a, b = third(n), third(n * 2)
    own = F.array(key(n, "f", F.substring(s, F.lit(1), a)), key(n, "m", s.substr(a + 1, b - a)), key(n, "l", s.substr(b + 1, n - b)))
    held = src.select(s.alias("a"), F.col("home").alias("cell"), F.explode(F.array_distinct(own)).alias("key"))
    probes = []
    for less in range(REACH + 1):
        m = n - less
        ma, mb = third(m), third(m * 2)
        probes += [key(m, "f", F.substring(s, F.lit(1), ma)), key(m, "l", s.substr(n - (m - mb) + 1, m - mb))]
        # as many letters are lost before the middle third as behind it, so it has moved by 0 or by all that is missing, or one less
        probes += [key(m, "m", s.substr(F.greatest(ma + 1 + shift, F.lit(1)), mb - ma)) for shift in range(max(-1, less - 1), 2)]
    seek = src.select(s.alias("b"), F.explode(F.array_distinct(F.array(*probes))).alias("key"), "cells").select("b", "key", F.explode("cells").alias("cell"))
    near = F.levenshtein(F.col("a"), F.col("b"), REACH)
    # the keys are many times the strings they come from, which size estimates do not see: never broadcast them
    met = held.join(seek.hint("merge"), ["cell", "key"]).where("a <> b").where((near >= 0) & (near <= allowed(F.col("a"), F.col("b"), short))).select("a", "b")
    return _both(met).distinct()


def prefixes(strings: DataFrame, col: str, least: int = 5) -> DataFrame:
    """(a, b) of all pairs of strings of which one starts with the other, in both orders; the shorter has ``least`` letters or more."""
    src = strings.select(F.col(col).alias("a")).where(F.length("a") >= least).distinct()
    starts = src.where(F.length("a") > least).select(F.col("a").alias("b"), F.explode(F.transform(F.sequence(F.lit(least), F.length("a") - 1), lambda n: F.substring("a", F.lit(1), n))).alias("a"))
    return _both(starts.hint("merge").join(src, "a").select("a", "b"))

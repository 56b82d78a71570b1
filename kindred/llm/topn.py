"""Top N of every group by simultaneous bisection (problem 5).

Every row has an order-preserving code: the negated scores, then the identifier's bytes in chunks of six, each a double that
holds its chunk exactly; a smaller code is a better row, and equal codes mean equal rows. All groups refine their cutoffs at
once. A round places SECTIONS - 1 midpoints between the best and the worst code that a group has left, counts the group's rows
between the midpoints (combined before the shuffle, so a group of millions sends a few counts a task), keeps the section in
which the N-th row lies, and settles all others: better sections are taken, worse ones dropped. Rows of settled sections are
never read again. A group ends when its taken rows are exactly N. No group is ever gathered or sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.scratch import Scratch
from kindred.skew import hot_keys, salted_join

SECTIONS = 32
#: Chunks of 6 bytes that one pass of refinement sees; rows equal in all of them go on with the next chunks.
CHUNKS = 8
BIGGEST = 1.7976931348623157e308


def _codes(item: str, scores: list[str], chunks: int, skip: int) -> list:
    finite = [F.greatest(F.least(-F.col(s), F.lit(BIGGEST)), F.lit(-BIGGEST)) + F.lit(0.0) for s in scores]
    data = F.encode(F.col(item), "UTF-8")
    parts = [F.conv(F.rpad(F.hex(F.substring(data, skip + 6 * k + 1, 6)), 12, "0"), 16, 10).cast("double") for k in range(chunks)]
    return [*finite, *parts]


def top_n(rows: DataFrame, keys: list[str], item: str, scores: list[str], n: str, scratch: Scratch | None = None, skip: int = 0) -> DataFrame:
    """(keys, item) of the best rows of each group: scores descending, then item ascending by its bytes.

    ``n`` is a column with the group's N, equal in all its rows. Items of a group must be distinct. The first score must be a
    number in every row (callers leave others out); nulls and NaN in later scores rank last. Infinite scores equal the largest
    double. Rows with a null key or item are left out. A group with fewer rows
    gives them all; N < 1 gives none; an empty table gives an empty table. ``skip`` bytes of the identifiers are known to be equal.
    """
    scratch = scratch or Scratch(rows.sparkSession, "topn")
    spread = "_item"
    src = rows.where(F.col(item).isNotNull() & (F.col(n) >= 1))
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    clean = [F.when(F.col(s).isNull() | F.isnan(F.col(s).cast("double")), F.lit(-BIGGEST)).otherwise(F.col(s).cast("double")).alias(f"_s{i}") for i, s in enumerate(scores)]
    src = scratch.cut(src.select(*keys, F.col(item).alias("_item"), F.col(n).cast("long").alias("_n"), *clean))
    longest = src.agg(F.max(F.octet_length("_item"))).first()[0]
    if longest is None:
        return src.select(*keys, F.col("_item").alias(item))
    codes = _codes("_item", [f"_s{i}" for i in range(len(scores))], max(1, min(CHUNKS, -(-(longest - skip) // 6))), skip)
    names = [f"_c{i}" for i in range(len(codes))]
    open_ = scratch.cut(src.select(*keys, "_item", "_n", *[c.alias(x) for c, x in zip(codes, names)]))
    scratch.drop(src)
    ends = [f(x).alias(f"{p}{x}") for x in names for f, p in ((F.min, "lo"), (F.max, "hi"))]
    level = F.lit(None).cast("int")
    for i in reversed(range(len(names))):
        level = F.when(F.col(f"lo{names[i]}") < F.col(f"hi{names[i]}"), F.lit(i)).otherwise(level)
    pick = lambda p: F.coalesce(*[F.when(F.col("_level") == i, F.col(p + x)) for i, x in enumerate(names)])

    sizes = open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"), F.max("_n").alias("_need"), *ends)
    # _upto: sections before it are taken; _at: the section still open; groups that fit are taken whole
    state = scratch.cut(
        sizes.withColumn("_level", level).select(
            *keys, "_count", "_need", F.when(F.col("_count") <= F.col("_need"), 1).otherwise(0).alias("_upto"), F.when(F.col("_count") <= F.col("_need"), -1).otherwise(0).alias("_at"), "_level", pick("lo").alias("_lo"), pick("hi").alias("_hi")
        )
    )
    total = state.agg(F.sum("_count")).first()[0] or 0
    hot = scratch.cut(hot_keys(state, keys, "_count", total))
    taken: list[DataFrame] = []
    open_ = open_.withColumn("_b", F.lit(0))
    ties: list[DataFrame] = []
    while True:
        value = F.coalesce(*[F.when(F.col("_level") == i, F.col(x)) for i, x in enumerate(names)]) * 0.5
        lo, hi = F.col("_lo") * 0.5, F.col("_hi") * 0.5
        section = F.least(F.lit(SECTIONS - 1), F.floor((value - lo) / (hi - lo) * SECTIONS)).cast("int")
        met = salted_join(open_, state.drop("_count", "_n"), keys, hot, spread).where("_b <= _at or _b < _upto")
        done = scratch.cut(
            met.select(*keys, "_item", F.col("_need").alias("_n"), *names, (F.col("_b") < F.col("_upto")).alias("_taken"), F.col("_level").isNull().alias("_tie"), F.when(F.col("_b") >= F.col("_upto"), section).alias("_b"))
        )
        taken.append(done.where("_taken").select(*keys, "_item"))
        ties.append(done.where("not _taken and _tie").select(*keys, "_item", "_n"))
        open_ = done.where("not _taken and not _tie").select(*keys, "_item", "_n", *names, "_b")
        counts = open_.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_count"), F.max("_n").alias("_need"), *ends)
        before = F.sum("_count").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_count")
        state = scratch.cut(
            counts.withColumn("_before", before)
            .where("_before < _need and _before + _count >= _need")
            .withColumn("_level", level)
            .withColumn("_full", F.col("_before") + F.col("_count") == F.col("_need"))
            .select(
                *keys, F.col("_count"), (F.col("_need") - F.col("_before")).alias("_need"), (F.col("_b") + F.col("_full").cast("int")).alias("_upto"), F.when(F.col("_full"), F.lit(-1)).otherwise(F.col("_b")).alias("_at"),
                "_level", pick("lo").alias("_lo"), pick("hi").alias("_hi"),
            )
        )
        if not state.limit(1).count():
            break
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    tied = ties[0]
    for t in ties[1:]:
        tied = tied.unionByName(t)
    tied = scratch.cut(tied)
    if skip + 6 * CHUNKS < longest and tied.limit(1).count():
        # rows equal so far differ in later bytes only: the same refinement goes on there
        tied = top_n(tied, keys, "_item", [], "_n", scratch, skip + 6 * CHUNKS)
    return out.unionByName(tied.select(*keys, "_item")).withColumnRenamed("_item", item)


def ranked_pairs(rows: DataFrame, list_name: str, group: str, item: str, n: int) -> DataFrame:
    """The pairs of a scored table as rows for top_n: each pair once, with its highest number p; pairs without one are left out."""
    p = F.when(~F.isnan(F.col("p").cast("double")), F.col("p").cast("double"))
    return (
        rows.select(F.col(group).alias("group_id"), F.col(item).alias("item_id"), p.alias("p"), F.col("sim").cast("double").alias("sim"))
        .where("p is not null and group_id is not null and item_id is not null")
        .groupBy("group_id", "item_id")
        .agg(F.max("p").alias("p"), F.max("sim").alias("sim"))
        .select(F.lit(list_name).alias("list_name"), "group_id", "item_id", "p", "sim", F.lit(n).alias("n"))
    )

"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 64
SALTS = 32


def hot_keys(counts: DataFrame, keys: list[str], count: str, total: int, share: int = HOT_SHARE) -> DataFrame:
    """The keys with more than total/share rows: at most ``share`` rows, so the result may be broadcast at any scale."""
    return counts.where(F.col(count) > F.lit(max(total // share, 1000))).select(*keys)


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows with a table that has one row per key. Rows of hot keys are spread over ``salts`` partitions by the hash of the
    column ``spread``; only the table's hot rows are repeated. Null keys join nothing."""
    flag = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    left = rows.join(flag, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    right = (
        table.join(flag, keys, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """rows with the columns of a table that has one row per key, hot keys salted by the hash of ``spread``. The hot keys are found in the
    plan itself, by counts that are combined before the shuffle: nothing is run ahead."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_n") > F.greatest(F.floor(F.col("_total") / HOT_SHARE), F.lit(1000)))  # one row; at most HOT_SHARE rows
    return salted_join(rows, table, [key], hot.select(key), spread, how)


def lookup_counted(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner", counted: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """As lookup(), for written rows: the hot keys are counted ahead in them, or in ``counted``, a written table with the same values of the
    key (``total``: its rows, where the caller has counted them), and stand in the plan as values, never more than HOT_SHARE. A plan that
    finds them itself holds rows five times, and 25 times where one lookup follows another, which in loops of small steps is most of the
    driver's memory."""
    source = (rows if counted is None else counted).select(key)
    total = source.count() if total is None else total
    # a table of no more rows than a hot key has at least holds no hot key
    counts = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")) if total > 1000 else None
    hot = [r[0] for r in hot_keys(counts, [key], "_n", total).collect()] if counts is not None else []
    if not hot:
        return rows.join(table, key, how)
    flag = F.col(key).isin(hot)
    left = rows.withColumn("_salt", F.when(flag, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    right = table.withColumn("_salt", F.explode(F.when(flag, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")

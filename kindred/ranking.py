"""Places and running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.scratch import Scratch


def running_sum(df: DataFrame, order: list[str], value: Column, out: str, scratch: Scratch) -> DataFrame:
    """Adds out: the sum of value over all rows up to this one in the order of columns that together are unique.

    Rows are written in ranges of the order; each range sums for itself and starts from the total of the ranges before it, one
    number a range."""
    w = scratch.cut(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = w.groupBy("_part").agg(F.sum("_v").alias("s")).orderBy("_part").collect()  # one row a range
    before, at = [], None
    for r in totals:
        before.append((r["_part"], at))
        at = r["s"] if at is None else at + (r["s"] or 0)
    kind = w.schema["_v"].dataType.simpleString()
    kind = {"int": "bigint"}.get(kind, kind)
    offsets = df.sparkSession.createDataFrame([(p, v if v is not None else (0.0 if kind == "double" else 0)) for p, v in before], f"_part int, _before {kind}")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return w.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.sum("_v").over(inside)).drop("_v", "_part", "_before")


def place(df: DataFrame, order: list[str], out: str, scratch: Scratch) -> DataFrame:
    """Adds out: 1 for the first row in the order of columns that together are unique, 2 for the next, and so on."""
    return running_sum(df, order, F.lit(1).cast("bigint"), out, scratch)

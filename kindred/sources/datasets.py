"""Benchmark datasets: two tables, the true pairs, and a description."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.files import read_text, write_text


def validate_dataset(left: DataFrame, right: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: sizes, repeated and missing IDs of both sides, repeated true pairs and true pairs of unknown records."""

    def side(df: DataFrame, name: str) -> DataFrame:
        by = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{name}"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n") - 1)), F.lit(0)).alias(f"repeated_{name}_ids"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias(f"missing_{name}_ids"))

    t = truth.groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_truth"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_pairs"))
    unknown = t.join(left.select(F.col("id").alias("left_id")).distinct().withColumn("_l", F.lit(1)), "left_id", "left").join(right.select(F.col("id").alias("right_id")).distinct().withColumn("_r", F.lit(1)), "right_id", "left")
    unknown = unknown.agg(F.count(F.when(F.col("_l").isNull() | F.col("_r").isNull(), 1)).alias("unknown_pairs"))
    return side(left, "left").crossJoin(side(right, "right")).crossJoin(pairs).crossJoin(unknown)  # one row each


def write_dataset(folder: str, left: DataFrame, right: DataFrame, truth: DataFrame, meta: dict) -> dict:
    """Three Parquet tables and meta.json with the validation counts; refuses a dataset with faults."""
    counts = validate_dataset(left, right, truth).first().asDict()
    faults = {k: v for k, v in counts.items() if v and not k.startswith("n_")}
    if faults:
        raise ValueError(f"the dataset has faults: {faults}")
    for name, df in (("left", left), ("right", right), ("truth", truth)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    write_text(left.sparkSession, f"{folder}/meta.json", json.dumps(meta | {"validation": counts}, indent=1, sort_keys=True))
    return counts


def load_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    return *(spark.read.parquet(f"{folder}/{n}.parquet") for n in ("left", "right", "truth")), json.loads(read_text(spark, f"{folder}/meta.json"))


def sample_left(left: DataFrame, truth: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """n left records in the order of their hash and their true pairs; the right table stays whole."""
    few = left.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(n)
    return few, truth.join(few.select(F.col("id").alias("left_id")), "left_id", "left_semi")

"""TF-IDF vectors as long tables, and exact nearest neighbours by an inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from kindred.functions.text import text_grams, word_grams
from kindred.operators.grid import BLOCK, PLACES, GramIndex, flat, over_cells
from kindred.scratch import Scratch


def clip_cosine(c: Column) -> Column:
    """A cosine within 0 and 1, exactly 1 when it is closer than the rounding error."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(c, PLACES)))
    return F.when(F.abs(c - 1) <= 1e-11, F.lit(1.0)).otherwise(c)


def gram_weights(left: DataFrame, right: DataFrame, low: int, high: int, groups: list[str] = (), whole_text: bool = False, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Unit TF-IDF vectors of two sides fitted on both together: (text, groups, gram, w) of each side's distinct texts.

    Sides have (id, text, *groups). Inverse document frequencies are ln((1 + N) / (1 + df)) + 1 over all rows of a group, repeated
    texts counted as often as they occur; every text is cut into grams once.
    """
    g = list(groups)
    grams = (text_grams if whole_text else word_grams)(F.col("text"), low, high)
    count = lambda d: d.groupBy("text", *g).agg(F.count(F.lit(1)).alias("_n"))
    texts = count(left).withColumn("_l", F.lit(True)).withColumn("_r", F.lit(False)).unionByName(count(right).withColumn("_l", F.lit(False)).withColumn("_r", F.lit(True)))
    texts = texts.groupBy("text", *g).agg(F.sum("_n").alias("_n"), F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    tf = texts.withColumn("gram", F.explode(grams)).groupBy("text", *g, "gram").agg(F.count(F.lit(1)).alias("tf"), F.first("_n").alias("_n"), F.first("_l").alias("_l"), F.first("_r").alias("_r"))
    total = texts.groupBy(*g).agg(F.sum("_n").alias("_total"))
    df = tf.groupBy("gram", *g).agg(F.sum("_n").alias("_df"))
    # one row without groups; with groups there may be any number of them, so size estimates decide
    df = df.join(total, g) if g else df.crossJoin(F.broadcast(total))
    idf = F.log((1.0 + F.col("_total")) / (1.0 + F.col("_df"))) + 1.0
    raw = tf.join(df.select("gram", *g, idf.alias("_idf")), ["gram", *g]).withColumn("_w", F.col("tf") * F.col("_idf"))
    norm = raw.groupBy("text", *g).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    unit = raw.join(norm, ["text", *g]).select("text", *g, "gram", (F.col("_w") / F.col("_norm")).alias("w"), "_l", "_r")
    if scratch:  # both sides read one written table instead of making all vectors twice
        unit = scratch.cut(unit)
    return unit.where("_l").drop("_l", "_r"), unit.where("_r").drop("_l", "_r")


def vectors(left: DataFrame, right: DataFrame, low: int, high: int, groups: list[str] = (), whole_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(text, groups, h, w, _l, _r): the unit vectors of gram_weights() as arrays, one row a distinct text: grams by their 64-bit hash, in
    order, their weights, and the sides that have the text."""
    g, spark = list(groups), left.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grams = (text_grams if whole_text else word_grams)(F.col("text"), low, high)
    count = lambda d, l: d.groupBy("text", *g).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_l": F.lit(l), "_r": F.lit(not l)})
    texts = count(left, True).unionByName(count(right, False)).groupBy("text", *g).agg(F.sum("_n").alias("_n"), F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    # few bytes of text become many grams: a number of tasks that size estimates may not shrink
    hashed = texts.repartition(tasks, "text", *g).withColumn("_grams", grams).withColumn("_hs", F.transform("_grams", lambda x: F.xxhash64(x, *g))).drop("_grams")
    kept = StructType([f for f in hashed.schema.fields if f.name != "_hs"])
    schema = StructType([*kept.fields, T.StructField("h", T.ArrayType(T.LongType())), T.StructField("tf", T.ArrayType(T.LongType()))])

    def tally(batches):
        for b in batches:
            h, at = flat(b.column("_hs"))
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.empty(0, np.int64)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row[first], minlength=b.num_rows))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[first], np.diff(np.append(first, len(h))))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept.names), *lists], names=schema.names)

    rows = scratch.cut(hashed.mapInArrow(tally, schema).withColumn("_id", F.monotonically_increasing_id()))
    total = texts.groupBy(*g).agg(F.sum("_n").alias("_total"))
    df = rows.select(*g, "_n", F.explode("h").alias("h")).groupBy("h", *g).agg(F.sum("_n").alias("_df"))
    df = df.join(total, g) if g else df.crossJoin(F.broadcast(total))  # one row without groups
    idf = (F.log((1.0 + F.col("_total")) / (1.0 + F.col("_df"))) + 1.0).alias("_idf")
    each = rows.select("_id", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("_id", "x.h", "x.tf")
    each = each.join(df.select("h", idf), "h").select("_id", "h", (F.col("tf") * F.col("_idf")).alias("w"))
    packed = each.repartition(tasks, "_id").sortWithinPartitions("_id", "h").mapInArrow(_pack, "_id long, h array<long>, w array<double>")
    return packed.join(rows.drop("h", "tf", "_n"), "_id").select("text", *g, "h", "w", "_l", "_r")


def _pack(batches):
    """Sorted rows (_id, h, w) as one row an _id, the weights brought to length 1. Only the last _id of a batch waits for the next one."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]

    def rows(ids, h, w):
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.empty(0, np.int64)
        offsets = np.append(first, len(ids))
        w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, first)) if len(first) else np.empty(0), np.diff(offsets))
        lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (h, w)]
        return pa.RecordBatch.from_arrays([pa.array(ids[first]), *lists], names=["_id", "h", "w"])

    for b in batches:
        mine = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, b.columns)]
        cut = int(np.searchsorted(mine[0], mine[0][-1])) if len(mine[0]) else 0
        yield rows(*(x[:cut] for x in mine))
        held = [x[cut:] for x in mine]
    yield rows(*held)


def packed_cosines(pairs: DataFrame, schema: str) -> DataFrame:
    """Adds sim to rows with two packed vectors (ha, wa) and (hb, wb), which it drops; a missing vector gives 0. ``schema`` names the
    columns that stay."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            keys, rows, weights = [], [], []
            for h, w in (("ha", "wa"), ("hb", "wb")):
                x, at = flat(b.column(h))
                keys.append(x)
                rows.append(np.repeat(np.arange(n), np.diff(at)))
                weights.append(flat(b.column(w))[0])
            key, row, weight = map(np.concatenate, (keys, rows, weights))
            order = np.lexsort((key, row))
            key, row, weight = key[order], row[order], weight[order]
            both = np.flatnonzero((key[1:] == key[:-1]) & (row[1:] == row[:-1]))  # a gram is in a vector once
            sim = np.bincount(row[both], weight[both] * weight[both + 1], n)
            keep = [c for c in b.schema.names if c not in ("ha", "wa", "hb", "wb")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sim)], names=[*keep, "sim"])

    return pairs.mapInArrow(run, schema + ", sim double").withColumn("sim", clip_cosine(F.col("sim")))


def nearest_texts(left: DataFrame, right: DataFrame, packed: DataFrame, k: int, min_sim: float, groups: list[str] = (), reverse: bool = False, block: int = BLOCK) -> DataFrame:
    """(lt, rt, groups, sim) of at least the texts that can hold a left text's k best rows, exactly; ``packed`` is vectors() of both
    sides. ``reverse`` searches left texts for every right one.

    Common grams make nearly all pairs share something, so postings are not joined: texts meet in a grid of blocks, and each block's
    index is searched rare grams first (see GramIndex). A result has k rows a text and block, ties by the text's smallest ID."""
    g = list(groups)
    mine, theirs, items = ("_r", "_l", left) if reverse else ("_l", "_r", right)
    first = items.groupBy("text", *g).agg(F.min("id").alias("first"))
    cols = ["text", *g, "first", "h", "w"]
    a = packed.where(mine).withColumn("first", F.lit(None).cast(first.schema["first"].dataType)).select(*cols)
    b = packed.where(theirs).join(first, ["text", *g]).select(*cols)
    schema = T.StructType([T.StructField("lt", T.StringType()), *(T.StructField(x, packed.schema[x].dataType) for x in g), T.StructField("rt", T.StringType()), T.StructField("sim", T.DoubleType())])
    names = schema.names
    found = over_cells(a, b, g, ["first", "text"], lambda held: GramIndex(held, k, min_sim, g, names), schema, block)
    return found.withColumn("sim", clip_cosine(F.col("sim")))


def nearest(left: DataFrame, right: DataFrame, cosines: DataFrame, k: int, min_sim: float, reverse: bool, groups: list[str] = ()) -> DataFrame:
    """(l, r) of the k best partners of every record: by sim, then the smaller ID. ``reverse`` ranks lefts for every right; cosines then
    have right texts as lt.

    Ranking runs on distinct texts first: of a text's rows only the k smallest IDs can be among the k best of anybody. With
    min_sim 0 the places left over go to the smallest IDs, blank texts included.
    """
    g = list(groups)
    if reverse:
        left, right = right, left
    least = Window.partitionBy("text", *g).orderBy("id")
    few = right.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k).select(F.col("text").alias("rt"), F.col("id").alias("r"), *g)
    best = Window.partitionBy("lt", *g).orderBy(F.desc("sim"), "r")
    ranked = cosines.where((F.col("sim") >= min_sim) & (F.col("sim") > 0)).join(few, ["rt", *g]).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k)
    pairs = left.select(F.col("text").alias("lt"), F.col("id").alias("l"), *g).join(ranked.select("lt", *g, "r", "_k"), ["lt", *g])
    if min_sim <= 0:
        first = Window.partitionBy(*g).orderBy("id") if g else Window.orderBy("id")
        pad = right.select("id", *g).orderBy("id").limit(2 * k) if not g else right
        pad = pad.withColumn("_p", F.row_number().over(first)).where(F.col("_p") <= 2 * k).select(F.col("id").alias("r"), "_p", *g)  # 2k rows a group: k may be taken already
        options = left.select(F.col("id").alias("l"), *g)
        options = options.join(pad, g) if g else options.crossJoin(F.broadcast(pad))  # 2k rows in all
        spare = options.join(pairs.select("l", "r"), ["l", "r"], "left_anti").select("l", "r", (F.lit(k) + F.col("_p")).alias("_k"))
        both = pairs.select("l", "r", "_k").unionByName(spare)
        pairs = both.withColumn("_k", F.row_number().over(Window.partitionBy("l").orderBy("_k", "r"))).where(F.col("_k") <= k)
    return pairs.select(F.col("r").alias("l"), F.col("l").alias("r")) if reverse else pairs.select("l", "r")

"""Formatting copies found through merged Bloom filters (problem 3).

Pass 1 reads the 8-byte hash of every row's canonical form. Each partition fills two bit maps: hashes met once and hashes met
again. Maps are merged slice by slice as (o1 | o2, r1 | r2 | (o1 & o2)), which is associative, so they merge in a tree; a hash
met in two partitions shows in the third term. Pass 2 probes the merged map of repeats: a row that is not in it has no copy and
is a singleton without any shuffle; the possible repeats, true ones and a few false ones, are shuffled by their full canonical
form and grouped exactly. False positives therefore cost a little work and never a wrong copy.

The map that travels to the executors is bounded by MAX_BITS. Larger inputs take several waves, each with the hashes of one
class, so the false positive rate holds at any size. A wave reads only its own rows, writes its possible repeats and drops its map
before the next one begins: memory holds one map, and rows are written once and read twice whatever the number of waves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.scratch import Scratch
from kindred.skew import hot_keys, salted_join

BITS_PER_ROW = 16
MAX_BITS = 1 << 29  # 64 MB on an executor and on the driver
SLICE_BITS = 1 << 20
FAN = 64
PROBES = 2


def letters_digits(c: Column) -> Column:
    """Letters and digits only, in one case, the capital form of ß being SS; null stays null."""
    return F.replace(F.lower(F.upper(F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}]", ""))), F.lit("ß"), F.lit("ss"))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, n) bit numbers of each hash."""
    u = h.astype(np.uint64)
    step = ((u >> np.uint64(32)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([((u * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i) * step) >> np.uint64(7)) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def _merge(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    once = again = None
    for o, r in parts:
        o, r = np.frombuffer(zlib.decompress(o), np.uint8), np.frombuffer(zlib.decompress(r), np.uint8)
        if once is None:
            once, again = o.copy(), r.copy()
        else:
            again |= r
            again |= once & o
            once |= o
    return zlib.compress(once.tobytes(), 1), zlib.compress(again.tobytes(), 1)


def repeat_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The merged map of hashes that may occur twice or more, as bytes. hashes has one long column h."""
    slices = -(-bits // SLICE_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(slices * SLICE_BITS // 8, np.uint8), np.zeros(slices * SLICE_BITS // 8, np.uint8)
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            at = _places(h, bits)
            known = np.logical_and.reduce([(once[p >> 3] >> (p & 7)) & 1 for p in at]).astype(bool)
            for p in at[:, known | (n > 1)]:
                np.bitwise_or.at(again, p >> 3, (1 << (p & 7)).astype(np.uint8))
            for p in at:
                np.bitwise_or.at(once, p >> 3, (1 << (p & 7)).astype(np.uint8))
        step = SLICE_BITS // 8
        rows = [(k, once[k * step : (k + 1) * step], again[k * step : (k + 1) * step]) for k in range(slices)]
        rows = [x for x in rows if x[1].any()]
        part = int(np.bitwise_xor.reduce([int(zlib.crc32(x[1].tobytes())) for x in rows])) if rows else 0
        yield pa.RecordBatch.from_pydict(
            {"slice": [x[0] for x in rows], "part": [part % FAN] * len(rows), "once": [zlib.compress(x[1].tobytes(), 1) for x in rows], "again": [zlib.compress(x[2].tobytes(), 1) for x in rows]},
            schema=pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("again", pa.binary())]),
        )

    def merge(pdf):
        import pandas as pd

        if not len(pdf):
            return pdf
        once, again = _merge(list(zip(pdf["once"], pdf["again"])))
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [0], "once": [once], "again": [again]})

    schema = "slice int, part int, once binary, again binary"
    merged = hashes.mapInArrow(fill, schema).groupBy("slice", "part").applyInPandas(merge, schema).groupBy("slice").applyInPandas(merge, schema)
    out = np.zeros(slices * SLICE_BITS // 8, np.uint8)
    for row in merged.select("slice", "again").toLocalIterator():  # at most MAX_BITS together
        piece = np.frombuffer(zlib.decompress(row["again"]), np.uint8)
        out[row["slice"] * SLICE_BITS // 8 :][: len(piece)] = piece
    return out


def copies(df: DataFrame, key: str, canonical: list[Column], where: Column | None = None, scratch: Scratch | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """(row_id, first_id, copies) of every row that has at least one copy: equal in all canonical columns, null equal to null only.

    first_id is the smallest key of the set. Rows with a null key are left out; a repeated key is one row. ``where`` drops rows
    that are never cases. An empty table gives an empty result. Extra columns are not read.
    """
    scratch = scratch or Scratch(df.sparkSession, "copies")
    # a null is written unlike any canonical text, and the separator never occurs in one
    whole = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in canonical])
    rows = df.where(where) if where is not None else df
    rows = scratch.cut(rows.select(F.col(key).cast("string").alias("row_id"), whole.alias("form")).where("row_id is not null").withColumn("h", F.xxhash64("form")))
    total = rows.count()
    waves = max(1, -(-total * BITS_PER_ROW // max_bits))
    if waves > 1:  # each wave's rows lie in a folder of their own, so that a wave reads nothing else
        rows = scratch.cut(rows.withColumn("wave", F.pmod(F.shiftright("h", 3), F.lit(waves)).cast("int")), "wave")
    parts = []
    for wave in range(waves):
        mine = rows if waves == 1 else rows.where(F.col("wave") == wave).drop("wave")
        bits = max(1 << 13, min(max_bits, -(-total * BITS_PER_ROW // waves)))
        known = df.sparkSession.sparkContext.broadcast(repeat_filter(mine.select("h"), bits))

        def probe(batches, known=known, bits=bits):
            again = known.value
            for batch in batches:
                at = _places(batch.column("h").to_numpy(zero_copy_only=False), bits)
                yield batch.filter(pa.array(np.logical_and.reduce([(again[p >> 3] >> (p & 7)) & 1 for p in at]).astype(bool)))

        # what is left is written before the filter goes, so one filter at a time is in memory
        parts.append(scratch.cut(mine.mapInArrow(probe, mine.schema).select("row_id", "form")))
        known.destroy()
    maybe = parts[0]
    for p in parts[1:]:
        maybe = maybe.unionByName(p)
    sets = scratch.cut(maybe.groupBy("form").agg(F.min("row_id").alias("first_id"), F.max("row_id").alias("_last"), F.count(F.lit(1)).alias("copies")).where("first_id <> _last").drop("_last"))
    hot = hot_keys(sets, ["form"], "copies", total)
    return salted_join(maybe, sets, ["form"], hot, "row_id").select("row_id", "first_id", "copies").distinct()


def line_fields(line: Column) -> Column:
    """The labelled fields of a raw line, a JSON object or COL field VAL value ..., as one canonical text in the order of the labels.
    A field whose value has no letter or digit counts as left out; null for a null line."""
    tagged = F.regexp_extract_all(line, F.lit(r"(?s)\bCOL\s+(\S+)\s+VAL\b(.*?)(?=\bCOL\s+\S+\s+VAL\b|$)"), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(r"(?s)\bCOL\s+(\S+)\s+VAL\b(.*?)(?=\bCOL\s+\S+\s+VAL\b|$)"), F.lit(2))
    json = F.from_json(line, "map<string,string>")
    entry = lambda k, v: F.concat(letters_digits(k), F.lit("="), F.coalesce(letters_digits(v), F.lit("")))
    from_tags = F.zip_with(tagged, values, entry)
    from_json = F.transform(F.map_entries(json), lambda e: entry(e["key"], e["value"]))
    listed = F.when(F.ltrim(line).startswith("{") & json.isNotNull(), from_json).otherwise(from_tags)
    kept = F.filter(listed, lambda x: ~x.endswith("="))
    # a line in neither form is compared as a whole
    return F.when(F.size(listed) > 0, F.array_join(F.array_sort(kept), "\x1e")).otherwise(letters_digits(line))

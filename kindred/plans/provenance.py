"""What a run was made from: fingerprints of its inputs and of its settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.fields import parse_on, side_fields

FORMAT = "kindred-rows-v1"


def typed(df: DataFrame, column: str):
    """A value with its type's name, lossless: null, the text of whole numbers, the bits of doubles in decimal form, text as it is."""
    kind, c = df.schema[column].dataType.simpleString(), F.col(f"`{column}`")
    return F.when(c.isNull(), F.lit("[null]")).otherwise(F.to_json(F.array(F.lit(kind), c.cast("string") if kind not in ("binary",) else F.base64(c))) if not kind.startswith(("array", "map", "struct")) else F.concat(F.lit(kind), F.to_json(F.array(c))))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> dict:
    """{format, rows, columns, sha256} of a table as a bag of rows: the same for any order of rows and any partitioning.

    Row hashes are added up as four 64-bit numbers modulo 2**64, combined before the shuffle; the sums and the schema are hashed.
    Repeated rows count."""
    columns = list(columns or df.columns)
    row = F.sha2(F.concat_ws("\x1e", *[typed(df, c) for c in columns]), 256)
    part = lambda k: F.conv(F.substring(F.col("_h"), 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = df.select(row.alias("_h")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)]).first()
    import hashlib

    body = json.dumps([FORMAT, sums["n"], [[c, df.schema[c].dataType.simpleString()] for c in columns], [str(int(sums[f"s{k}"] or 0) % (1 << 64)) for k in range(4)]])
    return {"format": FORMAT, "rows": sums["n"], "columns": columns, "sha256": hashlib.sha256(body.encode()).hexdigest()}


def input_fingerprints(left: DataFrame, right: DataFrame, on, left_id: str, right_id: str) -> dict:
    """Both sides twice: the compared fields with the ID, and all columns."""
    fields = parse_on(on, unpaired=True)
    out = {}
    for side, df, key in (("left", left, left_id), ("right", right, right_id)):
        compared = list(dict.fromkeys([key, *(c for _, c in side_fields(fields, side))]))
        out[side] = {"compared": fingerprint(df, compared), "full": fingerprint(df)}
    return out

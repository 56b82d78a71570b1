"""Blocking of a stream of new records against a standing table.

The batch passes are plans over DataFrames, and the keyed ones (exact, initials without distinct) run on a stream as they are: a
stream-static join keeps no state. Ranked passes need the whole of both sides and stay batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.fields import parse_on
from kindred.functions.text import key_text


def exact_stream(stream: DataFrame, table: DataFrame, on, stream_id: str, table_id: str) -> DataFrame:
    """(left_id, right_id) of new records equal to standing ones in every field; incomplete keys never pair. Append mode, no state."""
    fields = parse_on(on)
    keys = [f"_k{i}" for i in range(len(fields))]
    a = stream.select(F.col(stream_id).alias("left_id"), *[key_text(stream, f.left).alias(k) for f, k in zip(fields, keys)])
    b = table.select(F.col(table_id).alias("right_id"), *[key_text(table, f.right).alias(k) for f, k in zip(fields, keys)])
    for k in keys:
        a, b = a.where(F.col(k) != ""), b.where(F.col(k) != "")
    return a.join(b, keys).select("left_id", "right_id")

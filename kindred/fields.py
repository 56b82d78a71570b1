"""How records are described: which fields are compared, and the checks on columns and IDs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One compared field. A field that only one side has keeps None for the other."""

    label: str
    left: str | None
    right: str | None


def parse_on(on, unpaired: bool = False) -> list[Field]:
    """Fields from column names and (left, right) pairs; with ``unpaired`` one member of a pair may be None."""
    items = [on] if isinstance(on, str) else list(on or [])
    if not items:
        raise ValueError("no field to compare was given")
    out = []
    for item in items:
        if isinstance(item, str):
            out.append(Field(item, item, item))
            continue
        left, right = item if isinstance(item, (tuple, list)) and len(item) == 2 else (0, 0)
        if not all(x is None or isinstance(x, str) for x in (left, right)) or left is right is None:
            raise ValueError(f"{item!r} is no field: give a column, or a pair of columns")
        if None in (left, right) and not unpaired:
            raise ValueError(f"{item!r} has one side only, and this step needs both")
        out.append(Field(left or right, left, right))
    for side in ("left", "right"):
        labels = [f.label for f in out if getattr(f, side)]
        if not labels:
            raise ValueError(f"the {side} records have no field")
        if len(labels) != len(set(labels)) and any(None in (f.left, f.right) for f in out):
            raise ValueError(f"two fields of the {side} record share a label; rename a column")
    return out


def side_fields(fields: list[Field], side: str) -> list[tuple[str, str]]:
    """(label, column) of the fields that one side has."""
    return [(f.label, getattr(f, side)) for f in fields if getattr(f, side)]


def check_columns(df: DataFrame, columns: list[str], side: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"{c!r} is no column of the {side} table, which has {df.columns}")


def check_ids(df: DataFrame, column: str, side: str) -> None:
    check_columns(df, [column], side)
    if df.groupBy(column).count().where("count > 1").limit(1).count():
        raise ValueError(f"IDs repeat in column {column!r} of the {side} table")



def align_ids(df: DataFrame, column: str, table: DataFrame, id: str) -> DataFrame:
    """df with its text IDs replaced by the table's own values, whatever their type; IDs that the table lacks, or has twice under one
    text, are an error."""
    known = table.groupBy(F.col(id).cast("string").alias("_text")).agg(F.min(id).alias("_own"), F.count_distinct(id).alias("_n"))
    used = df.select(F.col(column).cast("string").alias("_text")).distinct().join(known, "_text", "left")
    bad = used.where("_text is not null and (_n is null or _n > 1)").limit(3).collect()
    if bad:
        raise ValueError(f"column {column!r} holds IDs that the table does not have once: {[r['_text'] for r in bad]}")
    met = df.withColumn("_text", F.col(column).cast("string")).join(known.select("_text", "_own"), "_text", "left")
    return met.select(*[F.col("_own").alias(c) if c == column else F.col(c) for c in df.columns])
